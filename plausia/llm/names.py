"""Variant spellings of names typed by people.

A name is read into a *core*: its tokens without case, accents, titles, legal forms and order. Cores are
blocked by phonetic codes of their sorted tokens, compared token by token with Jaro–Winkler and a nickname
table, and accepted pairs are clustered by connected components. Within crowded blocks only those pairs are compared that
share what is left after deleting the letters in which they may differ, which are all that can be accepted. Names in short form (an initial, a cut-off
word, a nickname) join a cluster only if no other cluster fits them as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, shuffle_partitions
from .components import connected_components

#: Words that are no part of a name, by kind.
TITLES = {"dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "miss", "mx", "sir", "dame"}
LEGAL_FORMS = {"inc", "incorporated", "ltd", "limited", "gmbh", "company", "co", "corp", "corporation", "llc", "llp", "plc", "ag", "kg", "sa", "srl", "bv", "nv", "oy", "ab"}
LEADING = {"the", "project"}
#: Nicknames and the given names that they stand for.
NICKNAMES = {
    "abby": "abigail", "alec": "alexander", "alex": "alexander alexandra", "andy": "andrew andrea", "annie": "anne anna", "art": "arthur", "barb": "barbara", "becky": "rebecca", "ben": "benjamin",
    "beppe": "giuseppe", "bernie": "bernard", "bert": "albert herbert robert", "bess": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert",
    "bobby": "robert", "cathy": "catherine katherine", "charlie": "charles charlotte", "chris": "christopher christine", "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "dave": "david",
    "deb": "deborah", "dick": "richard", "dima": "dmitri", "dolly": "dorothea dorothy", "dot": "dorothea dorothy", "dottie": "dorothea dorothy", "drew": "andrew", "ed": "edward edwin", "eddie": "edward",
    "ella": "eleanor", "ellie": "eleanor", "eva": "evangeline", "fran": "frances francisco", "frank": "francis francisco franklin", "fred": "frederick alfred", "freddie": "frederick", "fritz": "frederick friedrich",
    "gabe": "gabriel", "gina": "regina", "greg": "gregory", "gus": "augustus", "hal": "henry", "hank": "henry", "hans": "johannes", "harry": "henry harold", "hattie": "henrietta harriet", "hetty": "henrietta",
    "inge": "ingrid ingeborg", "isa": "isabella", "izzy": "isabella isabel", "jack": "john", "jake": "jacob", "jan": "johannes", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome", "jim": "james",
    "jimmy": "james", "joe": "joseph", "johnny": "john", "kate": "katherine catherine", "kathy": "katherine catherine", "katie": "katherine catherine", "kit": "christopher", "larry": "lawrence", "lena": "helena magdalena",
    "lex": "alexander", "liam": "william", "lisa": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "manny": "emmanuel", "marge": "margaret", "matt": "matthew",
    "meg": "margaret", "mick": "michael", "mickey": "michael", "mike": "michael", "mitya": "dmitri", "molly": "mary", "nancy": "anne", "nate": "nathan nathaniel", "ned": "edward", "nell": "eleanor helen",
    "nellie": "eleanor helen", "nick": "nicholas", "nicky": "nicholas", "nora": "eleanor honora", "ollie": "oliver olivia", "olly": "oliver olivia", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick",
    "patty": "patricia", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "polly": "mary", "quin": "quentin", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert",
    "robbie": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander alexandra sandra", "sasha": "alexander alexandra", "steve": "stephen steven", "sue": "susannah susan",
    "susie": "susannah susan", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore", "tim": "timothy", "tina": "christina valentina", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "trish": "patricia", "val": "valentina valerie", "vicky": "victoria", "vic": "victor victoria", "wally": "walter", "walt": "walter", "wat": "walter", "will": "william", "willy": "william", "zach": "zachary", "zack": "zachary",
}
_FORMALS = {nick: frozenset(formal.split()) for nick, formal in NICKNAMES.items()}
#: Blocks of more cores than this are cut finer.
MAX_BLOCK = 200
#: Jaro–Winkler similarity from which tokens two slips apart are one, and tokens one slip apart; slips of a name in all.
SURE_SIMILARITY, LEAST_SIMILARITY, MOST_SLIPS = 0.94, 0.85, 2
#: Tokens shorter than this are never alike enough when they are two slips apart.
LEAST_LETTERS = 5
#: Names of up to so many words are matched to spellings that run two of them together; names of more than the second
#: number may differ in one word only. Words of more letters than the last have no slips.
MOST_JOINED, MOST_WORDS, LONGEST = 8, 12, 40
FULL, NICK, CUT, INITIAL = 0, 1, 2, 3

_SOUND = {c: d for d, letters in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in letters}


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def read(name: str) -> list[tuple[str, bool]]:
    """The tokens of the core, sorted, each with whether a full stop cut it off."""
    raw = [t for t in re.split(r"[\s_,;/\-‐-―]+", fold(name)) if t]
    tokens = [(re.sub(r"[^\w]", "", t), t.endswith(".")) for t in raw]
    tokens = [t for t in tokens if t[0]]
    bare = [t for t in tokens if t[0] not in TITLES and t[0] not in LEGAL_FORMS] or tokens
    while len(bare) > 1 and bare[0][0] in LEADING and not bare[0][1]:
        bare = bare[1:]
    if sum(len(t) > 1 for t, _ in bare) >= 2:
        bare = [t for t in bare if len(t[0]) > 1]
    return sorted((t, cut and len(t) > 1) for t, cut in bare)


def soundex(word: str) -> str:
    code, last = word[:1].upper(), _SOUND.get(word[:1], "")
    for c in word[1:]:
        digit = _SOUND.get(c, "")
        if digit and digit != last:
            code += digit
        if c not in "hw":
            last = digit
    return (code + "000")[:4]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    swapped = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter added, lost, changed or swapped with its neighbour turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


def two_slips(a: str, b: str) -> bool:
    """Whether at most two slips turn ``a`` into ``b``, no letter taking part in both."""
    if abs(len(a) - len(b)) > 2:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1] <= 2


def deletions(word: str, n: int = 1) -> set[str]:
    """The word and what is left after losing up to ``n`` letters: words ``n`` slips apart share one of these."""
    out = {word}
    for _ in range(n):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def token_form(token: str, cut: bool) -> int:
    return INITIAL if len(token) == 1 else CUT if cut else NICK if token in _FORMALS else FULL


@lru_cache(maxsize=1 << 18)
def match_tokens(a: tuple[str, bool], b: tuple[str, bool]) -> str | None:
    """``same``, ``slip``, ``slips`` (two) or the short form by which one token can stand for the other."""
    (x, x_cut), (y, y_cut) = a, b
    if x == y:
        return "same" if x_cut == y_cut or len(x) == 1 else "cut"
    if y in _FORMALS.get(x, ()) or x in _FORMALS.get(y, ()):
        return "nick"
    short, long, cut = (x, y, x_cut) if len(x) < len(y) else (y, x, y_cut)
    if len(short) == 1:
        return "initial" if long.startswith(short) else None
    if cut and long.startswith(short):
        return "cut"
    if x_cut or y_cut or min(len(x), len(y)) < 3 or abs(len(x) - len(y)) > 2 or len(long) > LONGEST:
        return None
    alike = jaro_winkler(x, y)
    if alike < LEAST_SIMILARITY:
        return None
    if one_slip(x, y):
        return "slip"
    return "slips" if alike >= SURE_SIMILARITY and len(short) >= LEAST_LETTERS and two_slips(x, y) else None


_SLIPS = {"same": 0, "slip": 1, "slips": 2}


def compare(a: list[tuple[str, bool]], b: list[tuple[str, bool]]) -> str | None:
    """How all tokens of ``a`` match those of ``b`` at best, or None: ``same``, ``slip`` with up to two slips, or ``short``
    through one short form (a nickname may come with a slip). A token is left to others only once they can use it."""
    if len(a) != len(b):
        return "same" if _run_together(a, b) or _run_together(b, a) else None
    if len(a) > MOST_WORDS:
        left, right = Counter(a) - Counter(b), Counter(b) - Counter(a)
        kind = match_tokens(next(iter(left)), next(iter(right))) if left.total() == 1 else None
        return "same" if not left else "slip" if kind in ("slip", "slips") else kind and "short"
    best = (4, None)

    def match(i: int, left: list[tuple[str, bool]], slips: int, short: str | None) -> None:
        nonlocal best
        if slips > (MOST_SLIPS if short is None else int(short == "nick")) or (short and len(a) < 2) or slips + 2 * bool(short) >= best[0]:
            return
        if i == len(a):
            best = (slips + 2 * bool(short), "short" if short else "slip" if slips else "same")
            return
        for j, token in enumerate(left):
            if token in left[:j]:
                continue
            kind = match_tokens(a[i], token)
            if kind in _SLIPS:
                match(i + 1, left[:j] + left[j + 1 :], slips + _SLIPS[kind], short)
            elif kind and short is None:
                match(i + 1, left[:j] + left[j + 1 :], slips, kind)

    match(0, list(b), 0, None)
    return best[1]


def _joined(tokens: list[tuple[str, bool]]) -> set[str]:
    """The core with two tokens run together, in every way."""
    words = [t for t, _ in tokens]
    if not 2 <= len(words) <= MOST_JOINED:
        return set()
    return {" ".join(sorted([x + y, *(w for k, w in enumerate(words) if k not in (i, j))])) for i, x in enumerate(words) for j, y in enumerate(words) if i != j}


def _run_together(a: list[tuple[str, bool]], b: list[tuple[str, bool]]) -> bool:
    """Whether ``a`` is ``b`` with two words typed as one."""
    return len(a) == len(b) - 1 and " ".join(t for t, _ in a) in _joined(b)


def _phrase(words: list[str]) -> str:
    """The words in order; of a long name, a hash of them."""
    joined = " ".join(sorted(words))
    return joined if len(words) <= MOST_WORDS else xxhash.xxh64_hexdigest(joined)


def block_keys(tokens: list[tuple[str, bool]]) -> set[str]:
    """Phonetic codes of the sorted tokens: of all but one of them, with the first or the last letter of that one.
    Spellings that run two words together meet the others under the core itself."""
    core = " ".join(t for t, _ in tokens)
    keys = {"5" + core} | {"5" + x for x in _joined(tokens)}
    if len(tokens) == 1:
        return keys | {"1" + soundex(core), "2" + soundex(core[::-1])}
    few = len(tokens) <= MOST_WORDS
    codes = [soundex(x) for x, _ in tokens]
    for i, (t, cut) in enumerate(tokens):
        plain = codes[:i] + codes[i + 1 :]
        sounds = {_phrase(plain)}
        for k, (x, _) in enumerate(tokens if few else ()):
            if k != i:
                sounds |= {_phrase([*plain[: k - (k > i)], soundex(formal), *plain[k + 1 - (k > i) :]]) for formal in _FORMALS.get(x, ())}
        firsts = {t[0]} | {f[0] for f in _FORMALS.get(t, ())}
        for s in sounds:
            keys |= {f"3{s} {c}" for c in firsts}
            if token_form(t, cut) == FULL:
                keys.add(f"4{s} {t[-1]}")
    return keys


def finer_keys(tokens: list[tuple[str, bool]]) -> set[tuple[str, bool]]:
    """What two cores share if :func:`compare` accepts them, and whether that is only for short forms.

    With up to two slips they share the tokens less up to two letters; through a short form the other tokens less
    a letter, and the first letter of what it stands for; run together, the core with the words joined.
    """
    words, few = [t for t, _ in tokens], len(tokens) <= MOST_WORDS
    once = [deletions(w) if 2 < len(w) <= LONGEST else {w} for w in words]
    out = {"5" + _phrase(words)} | {"5" + x for x in _joined(tokens)}
    for i, w in enumerate(words):
        rest = words[:i] + words[i + 1 :]
        twice = deletions(w, 2) if LEAST_LETTERS <= len(w) <= LONGEST else once[i]
        out |= {"6" + _phrase([d, *rest]) for d in twice} if few else {f"6{_phrase(rest)} {d}" for d in twice}
        for j in range(i if few else 0):
            others = [x for k, x in enumerate(words) if k not in (i, j)]
            out |= {"6" + _phrase([d, e, *others]) for d in once[i] for e in once[j]}
    keys = {(k, False) for k in out}
    for i, (t, _) in enumerate(tokens if len(tokens) > 1 else []):
        rest = words[:i] + words[i + 1 :]
        left = {_phrase(rest)} | {_phrase([d, *rest[:j], *rest[j + 1 :]]) for j in range(len(rest) if few else 0) for d in once[j + (j >= i)]}
        keys |= {(f"7{c} {r}", True) for c in {t[0]} | {f[0] for f in _FORMALS.get(t, ())} for r in left}
    return keys


def _read_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for names in batches:
        tokens = [read(n) for n in names["name"]]
        yield pd.DataFrame({
            "name": names["name"], "core": [" ".join(t + "." * c for t, c in ts) for ts in tokens],
            "form": [max((token_form(*t) for t in ts), default=-1) if len(ts) > 1 else FULL if ts else -1 for ts in tokens],
        })


def _tokens(core: str) -> list[tuple[str, bool]]:
    return [(t.rstrip("."), t.endswith(".")) for t in core.split(" ")]


def _keys_of_cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for cores in batches:
        rows = [(core, form, k) for core, form in zip(cores["core"], cores["form"], strict=True) for k in block_keys(_tokens(core))]
        yield pd.DataFrame(rows, columns=["core", "form", "block"])


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for cores in batches:
        for core, form in zip(cores["core"], cores["form"], strict=True):
            keys = finer_keys(_tokens(core))
            yield pd.DataFrame({"core": core, "form": form, "block": ["#" + k for k, _ in keys], "only_short": [o for _, o in keys]})


def _compare_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that are accepted and share a block."""
    for pairs in batches:
        rows = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = _tokens(a), _tokens(b)
            kind = compare(x, y)
            if kind and block_keys(x) & block_keys(y):
                rows.append((a, b, kind))
        yield pd.DataFrame(rows, columns=["a", "b", "kind"])


def candidate_pairs(cores: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """``a, b`` with ``a < b``: pairs of cores that share a block, or a finer key if it is crowded."""
    keyed = materialize(cores.mapInPandas(_keys_of_cores, "core string, form int, block string"), "keys")
    crowded = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max_block).select("block")
    plain = keyed.join(crowded, "block", "left_anti").select("core", "form", "block", F.lit(False).alias("only_short"))
    in_crowds = keyed.join(crowded, "block", "left_semi").select("core", "form").distinct()
    blocks = materialize(plain.unionAll(in_crowds.mapInPandas(_finer, "core string, form int, block string, only_short boolean")), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    wanted = (F.col("a.block") == F.col("b.block")) & (F.col("a.core") < F.col("b.core")) & (~F.col("a.only_short") | (F.col("a.form") != F.col("b.form")))
    return a.join(b, wanted).select(F.col("a.core").alias("a"), F.col("b.core").alias("b")).distinct()


def name_clusters(names: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """``name, cluster`` for each distinct ``name``; null and blank names, and those without a letter or digit,
    are left out. Names with the same core always share a cluster, however many there are."""
    distinct = names.where("name is not null").select("name").distinct()
    read_names = materialize(distinct.mapInPandas(_read_names, "name string, core string, form int").where("form >= 0"), "names")
    cores = read_names.select("core", "form").distinct()
    pairs = candidate_pairs(cores, max_block).repartition(shuffle_partitions(names.sparkSession), "a", "b").mapInPandas(_compare_pairs, "a string, b string, kind string")
    pairs = materialize(pairs, "pairs")
    edges = pairs.where("kind <> 'short'").select(F.col("a").alias("u"), F.col("b").alias("v"))
    short = pairs.where("kind = 'short'").select("a", "b")
    forms = cores.select(F.col("core").alias("weak"), F.col("form").alias("weak_form"))
    fits = short.unionAll(short.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("weak"), F.col("b").alias("strong"))
    fits = fits.join(forms, "weak").join(forms.select(F.col("weak").alias("strong"), F.col("weak_form").alias("strong_form")), "strong").where(F.col("weak_form") > F.col("strong_form"))
    fits = materialize(fits, "fits")
    for form in (NICK, CUT, INITIAL):
        here = fits.where(F.col("weak_form") == form)
        if here.isEmpty():
            continue
        known = connected_components(edges)
        placed = here.join(known.select(F.col("node").alias("strong"), "component"), "strong", "left").withColumn("component", F.coalesce("component", "strong"))
        clear = placed.groupBy("weak").agg(F.min("component").alias("lowest"), F.max("component").alias("highest")).where("lowest = highest")
        stars = known.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))  # the same components, settled
        edges = stars.unionAll(clear.select(F.col("weak").alias("u"), F.col("lowest").alias("v")))
    clusters = connected_components(edges).select(F.col("node").alias("core"), "component")
    return read_names.join(clusters, "core", "left").select("name", F.coalesce("component", "core").alias("cluster"))


def variant_pairs(names: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """``name_a, name_b``: each pair of different spellings in a cluster, in code point order."""
    clusters = materialize(name_clusters(names, max_block), "clusters")
    a, b = clusters.alias("a"), clusters.alias("b")
    return a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))


def typed_names(edges: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``name``: the entity names of relationship edges and, before the last dot, of dimension ids."""
    return edges.select(F.col("source_entity").alias("name")).unionAll(edges.select(F.col("target_entity").alias("name"))).unionAll(dimensions.where(F.col("id").contains(".")).select(F.regexp_extract("id", r"(?s)^(.*)\.[^.]*$", 1).alias("name")))
