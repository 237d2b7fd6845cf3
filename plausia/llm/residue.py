"""Template residue and error-page text.

A record is cut into passages. Passages that bear two or more unfilled slots, or a short wording that everyone
uses for errors, script notices and fillers, are *trusted* positives; all others are unlabelled. A naive Bayes model
over words, pairs of words and the shapes of slots is fitted to both by expectation–maximization over every passage of
the corpus. It alone scores the passages, trusted ones too, and a record is residue if its passages together say so.

Passages with slots are modelled apart from those without, since the words around a slot tell whether it
stands in place of content or is being talked about, which the same words elsewhere don't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, spread

#: Features are hashed to so many buckets, half of them for passages with slots: the model's size, whatever the corpus.
BUCKET_BITS = 19
BUCKETS = 1 << BUCKET_BITS
MOST_ROUNDS = 12
#: Rounds end when the expected number of residue passages changes by less than this share.
SETTLED = 2e-3
#: Pseudo-passages, shared between the classes by their sizes, that pull a feature's ratio to nothing.
SMOOTHING = 3.0
#: A single feature counts for at most so much.
MOST_RATIO = 9.0
#: Features seen in fewer passages than this say nothing of either class.
LEAST_COUNT = 1.5
LEAST_POSTERIOR = 0.95
#: Texts are read together up to so many characters.
CHARACTERS = 4_000_000
#: A trusted wording stands in a passage of at most so many words.
MOST_WORDS = 10

_SLOT = (
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<%[^<>\n]{1,60}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\$\[[^\[\]\n]{1,60}\]|<<[^<>\n]{1,60}>>|\[\[[^\[\]\n]{1,60}\]\]|\(\([^()\n]{1,60}\)\)"
    r"|%\([\w.]{1,40}\)[sdf]|\{[\w .-]{0,40}\}|<[a-z][\w .-]{0,40}>|\[[^\W\d][^\[\]\n\d=:]{0,60}\]|%%[\w .-]{1,40}%%|@@[\w .-]{1,40}@@|\$[a-z]\w{0,40}\$|#[a-z]\w{0,40}#|(?<![\w%])%[sd]\b|__[a-z]\w{0,40}__|_{4,}"
)
_TAG = r"</?(?:html|head|body|title|h[1-6]|div|p|br|hr|span|a|b|i|em|strong|ul|ol|li|table|tr|td|th|pre|code|center|script|noscript|style|meta|link|form|input|button|img)\b[^<>\x00]*>"
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\x00|[\r\n]+|(?<=[.!?])\s+|" + _TAG + "|" + _SLOT)
_WORD, _END, _NEXT, _SKIP, _HOLE = range(5)
#: Wordings of errors, script notices and fillers in common use.
TRUSTED = """
not found|be displayed|be found|be loaded|access denied|server error|bad gateway|service unavailable|temporarily unavailable|is unavailable|gateway timeout|too many requests|has expired|session expired|timed out|went wrong|failed to load|try again later|have permission|no longer exists|sign in to
introuvable|accès refusé|erreur interne|pas disponible|service indisponible|a expiré|existe pas|existe plus|réessayez
nicht gefunden|zugriff verweigert|interner serverfehler|nicht verfügbar|nicht erreichbar|ist abgelaufen|existiert nicht|erneut versuchen
no encontrada|no encontrado|se encontró|acceso denegado|error interno|no disponible|está disponible|ha caducado|ha expirado|no existe|inténtelo
enable javascript|turn on javascript|support javascript|support scripts|requires javascript|needs javascript|needs scripts|javascript disabled|javascript required|scripts disabled|javascript is disabled|javascript is required|javascript must be|activer javascript|activez javascript|besoin de javascript|javascript désactivé|javascript est désactivé|javascript est nécessaire
javascript aktivieren|sie javascript|javascript deaktiviert|javascript erforderlich|javascript wird blockiert|ohne javascript|ohne skripte|active javascript|activar javascript|habilite javascript|necesita javascript|javascript desactivado|javascript necesario|necesita scripts
lorem ipsum|dolor sit|sample text|dummy text|dummy content|placeholder text|filler text|text goes here|headline goes here|title goes here|content goes here|replace this text|replace this paragraph
texte d exemple|faux texte|contenu provisoire|blindtext|platzhaltertext|beispieltext|texto de ejemplo|texto de relleno|contenido provisional|texto provisional|contenido definitivo
""".strip().replace("\n", "|").split("|")
#: Words that may stand beside a status code.
STATUS_WORDS = {"http", "error", "status", "code", "erreur", "fehler", "código", "estado"}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


_ZERO, _SLOT_CODE = _hash("0"), _hash("§")


class Vocabulary(dict):
    """Numbers for tokens, with their kinds and codes in arrays."""

    def __init__(self):
        super().__init__()
        self.kinds, self.codes, self.inner = [], [], []

    def __missing__(self, token: str) -> int:
        first, inner, n = token[0], 0, len(self.kinds)
        if first == "\x00":
            kind, code = _END, 0
        elif first in "\r\n" or token.isspace():
            kind, code = _NEXT, 0
        elif first.isdigit():
            kind, code = _WORD, _hash(first + "##") if len(token) == 3 and first in "45" else _ZERO
        elif first.isalpha() and (len(token) < 4 or len(set(token)) > 1):
            kind, code = _WORD, _hash(token)
        elif re.fullmatch(_TAG, token):
            kind, code = _SKIP, 0
        else:
            words = re.findall(r"[^\W\d_]+", token)
            kind, code, inner = _HOLE, _hash("slot:" + re.sub(r"[^\W_]+", "a", token)[:6]), _hash("in:" + " ".join(words))
        self.kinds.append(kind)
        self.codes.append(code)
        self.inner.append(inner)
        self[token] = n
        return n


def mixed(*parts) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.uint64(0)
        for p in parts:
            out = (out ^ p) * _MIX
            out = out ^ (out >> np.uint64(29))
    return out


_SINGLE = np.array([_hash(w) for w in (p for p in TRUSTED if " " not in p)], np.uint64)
_PAIRS = mixed(*np.array([[_hash(w) for w in p.split()] for p in TRUSTED if p.count(" ") == 1], np.uint64).T)
_TRIPLES = mixed(*np.array([[_hash(w) for w in p.split()] for p in TRUSTED if p.count(" ") == 2], np.uint64).T)
_STATUS_CODES = np.array([_hash("4##"), _hash("5##")], np.uint64)
_STATUS = np.array([*map(_hash, STATUS_WORDS)], np.uint64)
_LATIN = mixed(*np.array([[_hash(w) for w in p.split()] for p in ("lorem ipsum", "dolor sit")], np.uint64).T)


def read(texts: list[str], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passages (sentences and lines) of the texts: of each its text's number, whether it is trusted, whether
    it has slots, and how many features; and the features of all of them in a row.

    Words are taken in lower case, numbers as one but for status codes. A passage with slots has features of its
    own for words and pairs; a slot counts by its signs and by what stands in it."""
    tokens = _TOKEN.findall("\n\x00\n".join(t.replace("\x00", " ") for t in texts).lower())
    ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    kinds, codes, inner = (np.array(x, t)[ids] if len(ids) else np.empty(0, t) for x, t in ((known.kinds, np.int8), (known.codes, np.uint64), (known.inner, np.uint64)))
    text_no, cut = np.cumsum(kinds == _END), np.cumsum((kinds == _END) | (kinds == _NEXT))
    tagged = np.zeros(cut[-1] + 1 if len(cut) else 0, bool)
    tagged[cut[kinds == _SKIP]] = True
    held = (kinds == _WORD) | (kinds == _HOLE)
    kinds, codes, inner, text_no, cut = kinds[held], codes[held], inner[held], text_no[held], cut[held]
    starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]) if len(cut) else np.empty(0, np.int64)
    n = len(starts)
    passage = np.repeat(np.arange(n), np.diff(np.r_[starts, len(cut)]))
    tagged, ends = tagged[cut[starts]] if n else np.empty(0, bool), np.r_[starts[1:], len(cut)] - 1 if n else starts
    is_hole = kinds == _HOLE
    holes = np.bincount(passage[is_hole], minlength=n)
    slotted, words = holes > 0, np.bincount(passage, minlength=n)
    plain = np.where(is_hole, np.uint64(_SLOT_CODE), codes)
    together = passage[1:] == passage[:-1]
    pairs, at_pair = mixed(plain[:-1], plain[1:])[together], passage[1:][together]
    three = together[1:] & together[:-1]
    triples = mixed(plain[:-2], plain[1:-1], plain[2:])[three] if len(plain) > 2 else np.empty(0, np.uint64)
    # trusted passages
    worded = np.zeros(n, bool)
    worded[passage[np.isin(plain, _SINGLE)]] = True
    worded[at_pair[np.isin(pairs, _PAIRS)]] = True
    worded[passage[2:][three][np.isin(triples, _TRIPLES)]] = True
    same = (plain[1:] == plain[:-1])[together] & (plain[1:][together] != np.uint64(_ZERO)) & (plain[1:][together] != np.uint64(_SLOT_CODE))
    repeats = np.bincount(at_pair[same], minlength=n)
    status, beside = np.isin(plain, _STATUS_CODES), np.isin(plain, _STATUS)
    bare_status = (np.bincount(passage[status], minlength=n) == 1) & (np.bincount(passage[status | beside], minlength=n) == words)
    opens = np.zeros(n, bool)
    opens[at_pair[np.isin(pairs, _LATIN) & (np.flatnonzero(together) == starts[at_pair])]] = True
    trusted = (holes >= 2) | ((words <= MOST_WORDS) & (worded | (repeats >= 2))) | bare_status | opens
    # features
    free = ~slotted
    feats = [plain[~(is_hole & slotted[passage])], pairs, codes[is_hole], inner[is_hole], mixed(plain[starts], np.uint64(11))[free], mixed(plain[ends], np.uint64(13))[free]]
    at = [passage[~(is_hole & slotted[passage])], at_pair, passage[is_hole], passage[is_hole], np.flatnonzero(free), np.flatnonzero(free)]
    for mark, number in ((free & (words <= 4), 17), (free & tagged, 19)):
        feats.append(np.full(mark.sum(), mixed(np.uint64(number)), np.uint64))
        at.append(np.flatnonzero(mark))
    owner = np.concatenate(at).astype(np.int64)
    bucket = (np.concatenate(feats) & np.uint64(BUCKETS // 2 - 1)).astype(np.int64) + slotted[owner] * (BUCKETS // 2)
    keys = np.sort((owner << BUCKET_BITS) | bucket)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys  # each feature once a passage
    return text_no[starts], trusted, slotted, np.bincount(keys >> BUCKET_BITS, minlength=n), (keys & (BUCKETS - 1)).astype(np.int32)


_ROWS = pa.schema([("doc_id", pa.int64()), ("trusted", pa.list_(pa.bool_())), ("slotted", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])
_ROWS_DDL = "doc_id long, trusted array<boolean>, slotted array<boolean>, sizes array<int>, features array<int>"


def _lists(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)], pa.int32()), pa.array(values, kind))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Vocabulary()
    for batch in batches:
        texts, docs = batch.column("text").to_pylist(), batch.column("doc_id")
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) <= CHARACTERS:
                held += len(texts[end])
                end += 1
            if len(known) > 1_000_000:
                known = Vocabulary()
            text_no, trusted, slotted, sizes, flat = read(texts[at:end], known)
            per_text = np.bincount(text_no, minlength=end - at)
            per_row = np.bincount(text_no, sizes, minlength=end - at).astype(np.int64)
            yield pa.record_batch([docs.slice(at, end - at), _lists(trusted, per_text, pa.bool_()), _lists(slotted, per_text, pa.bool_()), _lists(sizes.astype(np.int32), per_text, pa.int32()), _lists(flat, per_row, pa.int32())], schema=_ROWS)
            at = end


class Model:
    """Log ratio of each feature bucket between residue and content, and the log odds of a passage without and with slots."""

    def __init__(self, ratio: np.ndarray, odds: np.ndarray):
        self.ratio, self.odds = ratio.astype(np.float32), odds

    @classmethod
    def of(cls, counts: np.ndarray, passages: np.ndarray) -> Model:
        """From expected counts by class and bucket, and numbers of passages by class and kind. Pseudo-counts follow the
        sizes of the classes, so a rare feature tells little."""
        n, slotted = passages + 1e-9, np.repeat([0, 1], BUCKETS // 2)
        share = n / n.sum(axis=0)
        ratio = np.log((counts[0] + SMOOTHING * share[0][slotted]) / n[0][slotted]) - np.log((counts[1] + SMOOTHING * share[1][slotted]) / n[1][slotted])
        return cls(np.where(counts.sum(axis=0) < LEAST_COUNT, 0, np.clip(ratio, -MOST_RATIO, MOST_RATIO)), np.log(n[0] / n[1]))

    def posterior(self, slotted: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        sums = np.r_[0.0, np.cumsum(self.ratio[flat], dtype=np.float64)]
        score = self.odds[slotted.astype(np.int64)] + sums[ends] - sums[ends - sizes]
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    trusted, slotted, sizes, flat = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("trusted", "slotted", "sizes", "features"))
    return trusted.astype(bool), slotted.astype(bool), sizes.astype(np.int64), flat


#: Counts travel as so many stretches of the bucket range, each a block of numbers.
STRETCHES = 64
_TALLY = "stretch int, counts binary"


def _tally(model: Model | None):
    """Expected counts of each feature bucket in both classes over one task's passages, by stretches; the stretch -1 has
    the numbers of passages without and with slots. A trusted passage counts as residue."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros((2, BUCKETS)), np.zeros((2, 2))
        for batch in batches:
            trusted, slotted, sizes, flat = _flat(batch)
            p = trusted.astype(float) if model is None else np.where(trusted, 1.0, model.posterior(slotted, sizes, flat))
            weight, s = np.repeat(p, sizes), slotted.astype(np.int64)
            residue = np.bincount(flat, weight, BUCKETS)
            counts += [residue, np.bincount(flat, minlength=BUCKETS) - residue]
            passages += [np.bincount(s, p, 2), np.bincount(s, 1 - p, 2)]
        blocks = [passages, *np.split(counts, STRETCHES, axis=1)]
        yield pa.RecordBatch.from_pydict({"stretch": np.arange(-1, STRETCHES, dtype=np.int32), "counts": [b.astype(np.float32).tobytes() for b in blocks]})

    return tally


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, stretch = None, None
    for batch in batches:
        for block in batch.column("counts"):
            numbers = np.frombuffer(block.as_py(), np.float32)
            total = numbers.astype(np.float64) if total is None else total + numbers
        stretch = batch.column("stretch")[:1]
    yield pa.RecordBatch.from_pydict({"stretch": stretch, "counts": [total.tobytes()]})  # a sum over tasks needs the longer numbers


def fit(rows: DataFrame, most_rounds: int = MOST_ROUNDS) -> Model | None:
    """Expectation–maximization over all passages, until the expected number of residue passages settles. The driver
    sees the counts of the feature buckets, no passages. None if nothing is trusted, as nothing can be learned then."""
    model, before = None, 0.0
    for _ in range(most_rounds):
        sums = {r["stretch"]: np.frombuffer(r["counts"]) for r in rows.mapInArrow(_tally(model), _TALLY).groupBy("stretch").applyInArrow(_added, _TALLY).collect()}
        passages = sums[-1].reshape(2, 2) if sums else np.zeros((2, 2))
        residue = passages[0].sum()
        if not residue or not passages[1].sum():
            return None
        model = Model.of(np.concatenate([sums[i].reshape(2, -1) for i in range(STRETCHES)], axis=1), passages)
        if abs(residue - before) < SETTLED * residue:
            break
        before = residue
    return model


_SCORES = "doc_id long, n_passages long, n_trusted long, n_residue long, miss double"


def _scores(model: Model | None, least_posterior: float):
    """Per document its passages, how many are residue, and the log of the chance that none is."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trusted, slotted, sizes, flat = _flat(batch)
            p = model.posterior(slotted, sizes, flat) if model else np.zeros(len(sizes))
            n = batch.column("sizes").value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            add = lambda x: np.bincount(owner, x, len(n))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_passages": n.astype(np.int64), "n_trusted": add(trusted).astype(np.int64), "n_residue": add(p >= least_posterior).astype(np.int64), "miss": add(np.log1p(-np.minimum(p, 1 - 1e-12)))})

    return score


def passage_rows(documents: DataFrame) -> DataFrame:
    """One row per document with the features of its passages. Null ids and texts are left out; an empty text
    has no passages."""
    docs = spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return materialize(docs.mapInArrow(_passages, _ROWS_DDL), "passages", "zstd")


def record_scores(documents: DataFrame, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """``doc_id, n_passages, n_trusted, n_residue, posterior`` of every record: the posterior is that any of its
    passages is residue. The rows of a repeated ``doc_id`` are one record."""
    rows = passage_rows(documents)
    scored = rows.mapInArrow(_scores(fit(rows), least_posterior), _SCORES)
    return scored.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_passages", "n_trusted", "n_residue")), (1 - F.exp(F.sum("miss"))).alias("posterior"))


def residue_records(documents: DataFrame, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """The records of :func:`record_scores` that are residue with at least ``least_posterior``."""
    return record_scores(documents, least_posterior).where(F.col("posterior") >= least_posterior)
