"""Evaluation texts leaking into training text.

An exact leak is a run of ``RUN`` words in both. Word n-grams of the test items are looked up in the corpus, and
the rare ones are seeds, as is of every window of an item the rarest n-gram that occurs at all: each such run holds a
seed, so none is missed. Seeds join documents to items, Smith–Waterman alignment scores what lies around them, and a pair
whose score allows for a run is checked for it.

An edited copy need not share a seed, however common n-grams are. There the words and pairs of words that a
document has in common with an item bound the score of any Smith–Waterman alignment, and every pair that can
reach the least score is aligned.

The items travel to the corpus, in parts of bounded size, and alignment takes place where the document is: no text
is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, spread

GRAM, RUN = 5, 13
MATCH, MISMATCH, GAP = 2, -1, -1
SLACK = 8
#: Pairs are aligned together up to so many cells a step.
CELLS = 1 << 17
#: Items travel to the tasks in parts of at most so many words and characters; the corpus is read once per part.
MOST_SHIPPED, MOST_CHARACTERS = 2_000_000, 32_000_000
#: N-grams in at most this number of documents are rare.
RARE_COUNT = 50
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_codes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    codes = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        code = known.get(t)
        if code is None:
            code = known[t] = xxhash.xxh64_intdigest(t)
        codes[i] = code
    return codes


def gram_codes(codes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit code for each run of ``n`` words, by position."""
    if len(codes) < n:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) - n + 1, np.uint64)
        for i in range(n):
            out = out * _BASE + codes[i : len(codes) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith–Waterman score of each pair of word sequences, and their longest common run of words. Pairs of
    similar length are aligned together, a word of all first sequences at a time."""
    best, longest = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order:
        width = len(pairs[order[-1]][1])
        taken = [order.pop() for _ in range(min(len(order), max(1, CELLS // (width + 1))))]
        first = np.zeros((len(taken), max(len(pairs[i][0]) for i in taken)), np.uint64)  # 0 and 1 fill up and never match
        second = np.ones((len(taken), width), np.uint64)
        for k, i in enumerate(taken):
            first[k, : len(pairs[i][0])], second[k, : len(pairs[i][1])] = pairs[i]
        steps = np.arange(width + 1, dtype=np.int32) * GAP
        row, run = np.zeros((len(taken), width + 1), np.int32), np.zeros((len(taken), width + 1), np.int32)
        top, most = np.zeros(len(taken), np.int32), np.zeros(len(taken), np.int32)
        for x in first.T:
            same = second == x[:, None]
            here = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP, out=here[:, 1:], casting="unsafe")
            np.maximum(here, 0, out=here)
            row = np.maximum.accumulate(here - steps, axis=1) + steps
            new = np.zeros_like(run)
            new[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            run = new
            np.maximum(top, row.max(axis=1), out=top)
            np.maximum(most, run.max(axis=1), out=most)
        best[taken], longest[taken] = top, most
    return best, longest


def _item_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for items in batches:
        yield items.assign(n=[len(words(t)) for t in items["item_text"]])


def _parts(items: DataFrame, least_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items of at least so many words, in parts that fit into a task."""
    sized = materialize(items.mapInPandas(_item_sizes, "item_id long, item_text string, n long").where(F.col("n") >= least_words), "items")
    total, characters = sized.agg(F.sum(3 * F.col("n")), F.sum(F.length("item_text"))).first()
    parts = max(1, -(-(total or 0) // MOST_SHIPPED), -(-(characters or 0) // MOST_CHARACTERS))
    for i in range(parts):
        part = sized.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == i).select("item_id", "item_text").collect()
        if part:
            yield [tuple(r) for r in part]


def _lookup(shipped: np.ndarray):
    """Documents that hold n-grams of ``shipped``, with the places of these."""

    def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for docs in batches:
            if len(known) > 1_000_000:
                known = {}
            rows = []
            for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
                tokens = words(text)
                grams = gram_codes(word_codes(tokens, known))
                at = np.flatnonzero(shipped[np.minimum(np.searchsorted(shipped, grams), len(shipped) - 1)] == grams)
                if len(at):
                    rows.append((doc, " ".join(tokens), grams[at], at.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "grams", "positions"])

    return lookup


def seed_places(counts: np.ndarray) -> np.ndarray:
    """Which of an item's n-grams are seeds, by the number of documents that hold each: the rare ones, and of each
    window of ``RUN`` words the rarest that occurs at all."""
    found = np.where(counts > 0, counts, np.iinfo(np.int64).max)
    chosen = (counts > 0) & (counts <= RARE_COUNT)
    windows = np.lib.stride_tricks.sliding_window_view(found, min(len(found), RUN - GRAM + 1))
    rarest = windows.argmin(axis=1) + np.arange(len(windows))
    chosen[rarest[counts[rarest] > 0]] = True
    return np.flatnonzero(chosen)


def _spans(starts: np.ndarray, n_item: int, n_doc: int) -> list[list[int]]:
    """The parts of a document where the item may lie, by where its seeds let it begin."""
    spans: list[list[int]] = []
    for start in np.unique(starts).tolist():
        low, high = max(0, start - SLACK), min(n_doc, start + n_item + SLACK)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(high, spans[-1][1])
        else:
            spans.append([low, high])
    return spans


_PAIRS = "doc_id long, item_id long, score double, longest_run int"


def _scored(rows: list[tuple[int, int, int]], parts: list[tuple[np.ndarray, np.ndarray]], least: int = 1) -> pd.DataFrame:
    """``rows`` of document, item and perfect score with the alignment of their ``parts``, those that score ``least``."""
    score, run = align(parts)
    out = pd.DataFrame(rows, columns=["doc_id", "item_id", "perfect"])
    return pd.DataFrame({"doc_id": out["doc_id"], "item_id": out["item_id"], "score": score / out["perfect"], "longest_run": run})[score >= least]


def _around_seeds(items: list[tuple[int, np.ndarray]], seeds: list[np.ndarray], codes: list[np.ndarray], run: int):
    """Aligns each document with the items whose seeds it holds, around these; a run of words needs a score of as many matches."""
    owner, place = np.repeat(np.arange(len(items)), [len(s) for s in seeds]), np.concatenate(seeds)
    gram = np.concatenate([c[s] for c, s in zip(codes, seeds, strict=True)])
    order = np.argsort(gram, kind="stable")
    owner, place = owner[order], place[order]
    unique, first, sizes = np.unique(gram[order], return_index=True, return_counts=True)

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for hits in batches:
            rows, parts = [], []
            for doc, text, grams, positions in zip(hits["doc_id"], hits["words"], hits["grams"], hits["positions"], strict=True):
                at = np.minimum(np.searchsorted(unique, grams), len(unique) - 1)
                ok = unique[at] == grams
                n = sizes[at[ok]]
                met = np.repeat(first[at[ok]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                starts, whose = np.repeat(positions[ok], n).astype(np.int64) - place[met], owner[met]
                b = word_codes(text.split(" "), known) if len(met) else None
                for k in np.unique(whose):
                    item, a = items[k]
                    for low, high in _spans(starts[whose == k], len(a), len(b)):
                        rows.append((doc, item, MATCH * len(a)))
                        parts.append((a, b[low:high]))
            yield _scored(rows, parts, MATCH * run)

    return around


def _where_possible(items: list[tuple[int, str]], least_score: float):
    """Aligns each document with the items that it may match with ``least_score`` or has a run in common with.

    An alignment of M matched words in R unbroken runs costs at least R - 1, so it scores at most
    2 M - (R - 1) = M + (M - R) + 1: the words of the item that the document holds, its pairs of words that the
    document holds, and one. A document is looked at in parts that overlap by more than such an alignment is long.
    """
    known: dict[str, int] = {}
    texts = [word_codes(words(text), known) for _, text in items]
    parts = [(gram_codes(w, n), k, worth) for k, w in enumerate(texts) for n, worth in ((1, 1.0), (2, 1.0), (RUN, np.inf))]
    grams = np.concatenate([g for g, _, _ in parts])
    order = np.argsort(grams, kind="stable")
    owner = np.repeat([k for _, k, _ in parts], [len(g) for g, _, _ in parts])[order]
    worth = np.repeat([x for _, _, x in parts], [len(g) for g, _, _ in parts])[order]
    codes, first, sizes = np.unique(grams[order], return_index=True, return_counts=True)
    perfect = np.array([MATCH * len(w) for w in texts])
    reach = max(RUN, int(np.ceil(max(map(len, texts)) * max(1.0, 3 - 2 * least_score))))

    def where_possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for docs in batches:
            if len(known) > 1_000_000:
                known = {}
            rows, aligned = [], []
            for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
                tokens = words(text)
                w, may = word_codes(tokens, known), np.zeros(len(items), bool)
                for start in range(0, max(1, len(w) - reach), reach):
                    part = w[start : start + 2 * reach]
                    held = np.concatenate([gram_codes(part, n) for n in (1, 2, RUN)])
                    at = np.minimum(np.searchsorted(codes, held), len(codes) - 1)
                    at = np.unique(at[codes[at] == held])
                    n = sizes[at]
                    postings = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    may |= (np.bincount(owner[postings], worth[postings], len(items)) + 1) / perfect >= least_score
                for k in np.flatnonzero(may) if tokens else ():
                    rows.append((doc, items[k][0], MATCH * len(texts[k])))
                    aligned.append((texts[k], w))
            yield _scored(rows, aligned)

    return where_possible


def _clean(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).dropDuplicates(["item_id", "item_text"])
    return spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text")), items


def leaks(documents: DataFrame, items: DataFrame, least_score: float = 0.6) -> DataFrame:
    """``doc_id, item_id, score, longest_run``: pairs that either align with at least ``least_score`` of a
    perfect alignment or have ``RUN`` consecutive words in common (``longest_run`` is the most there are).

    Words are runs of letters and digits in lower case. Null texts and ids are left out, items shorter than an
    n-gram never match, and repeated item rows count once.
    """
    docs, items = _clean(documents, items)
    scored = docs.sparkSession.createDataFrame([], _PAIRS)
    for part in _parts(items, GRAM):
        scored = scored.unionAll(docs.mapInPandas(_where_possible(part, least_score), _PAIRS))
    return _best(scored).where((F.col("score") >= least_score) | (F.col("longest_run") >= RUN))


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))


def leaked_runs(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, item_id, score, longest_run`` of documents with at least ``run`` (13 or more) consecutive words of an
    item; the score is that around the seeds, ``SLACK`` words to either side of where they let the item lie."""
    docs, items = _clean(documents, items)
    out = docs.sparkSession.createDataFrame([], _PAIRS)
    for part in _parts(items, run):
        known: dict[str, int] = {}
        texts = [(item, word_codes(words(text), known)) for item, text in part]
        codes = [gram_codes(w) for _, w in texts]
        shipped = np.unique(np.concatenate(codes))
        hits = materialize(docs.mapInPandas(_lookup(shipped), "doc_id long, words string, grams array<long>, positions array<int>"), "hits")
        held = hits.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").count().toPandas()  # at most as many as were shipped
        counts = np.zeros(len(shipped), np.int64)
        counts[np.searchsorted(shipped, held["gram"].to_numpy(np.int64))] = held["count"]
        seeds = [seed_places(counts[np.searchsorted(shipped, c)]) for c in codes]
        if any(map(len, seeds)):
            out = out.unionAll(hits.mapInPandas(_around_seeds(texts, seeds, codes, run), _PAIRS))
    return _best(out.where(F.col("longest_run") >= run))
