"""Identity coupling: how alike the beliefs about two entities are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, spread
from ..functions.info import TINY, bhattacharyya, certainty

#: Fixed values of the merge decision.
MIN_OVERLAP, MERGE, MERGE_MIDDLE, MERGE_UNLIKE = 3, 0.97, 0.99, 0.995


def coupling(pairs: DataFrame, beliefs: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """``entity_a, entity_b, coupling`` of given pairs.

    0 with fewer than ``min_overlap`` attributes in common, if an attribute with a single value on both sides
    differs, or with too few attributes that tell anything; else the mean of the Bhattacharyya coefficients
    weighted by certainty.
    """
    own = beliefs.select("entity", "attribute", "dist", certainty(F.col("dist")).alias("sure"))
    a = own.select(F.col("entity").alias("entity_a"), "attribute", F.col("dist").alias("dist_a"), F.col("sure").alias("sure_a"))
    b = own.select(F.col("entity").alias("entity_b"), "attribute", F.col("dist").alias("dist_b"), F.col("sure").alias("sure_b"))
    common = pairs.select("entity_a", "entity_b").join(a, "entity_a").join(b, ["entity_b", "attribute"])
    single = (F.size("dist_a") <= 1) & (F.size("dist_b") <= 1)
    names = lambda d: F.array_sort(F.transform(d, lambda x: x["value"]))
    weight = (F.col("sure_a") + F.col("sure_b")) / 2 + 0.1
    scored = common.groupBy("entity_a", "entity_b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(single & (names(F.col("dist_a")) != names(F.col("dist_b")))).alias("clashes"), F.count_if(~single).alias("telling"),
        F.sum(bhattacharyya(F.col("dist_a"), F.col("dist_b")) * weight).alias("s"), F.sum(weight).alias("w"),
    )
    counts = (F.col("n") >= min_overlap) & (F.col("clashes") == 0) & (F.col("telling") >= max(2, min_overlap - 1))
    out = pairs.select("entity_a", "entity_b").join(scored, ["entity_a", "entity_b"], "left")
    return out.select("entity_a", "entity_b", F.when(counts, F.col("s") / F.col("w")).otherwise(0.0).alias("coupling"))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 if one holds the other, else the Jaccard share of common letter pairs."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))

    def pairs(s: Column) -> Column:
        return F.when(F.length(s) <= 1, F.array(s)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))))

    share = F.size(F.array_intersect(pairs(x), pairs(y))).cast("double") / F.size(F.array_union(pairs(x), pairs(y)))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(share)


def should_merge(score: Column, a: Column, b: Column) -> Column:
    """Unlike names need a stronger coupling."""
    near = name_similarity(a, b)
    return F.when(score < 0.5, False).when(near >= 0.6, score >= MERGE).when(near >= 0.3, score >= MERGE_MIDDLE).otherwise(score >= MERGE_UNLIKE)


def overlapping(queries: DataFrame, beliefs: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """``entity_a, entity_b, n_common``: the stated query entities against all others with enough attributes in
    common."""
    own = beliefs.select("entity", "attribute").distinct()
    asked = queries.select(F.col("entity").alias("entity_a")).distinct().join(own.withColumnRenamed("entity", "entity_a"), "entity_a")
    met = asked.join(own.withColumnRenamed("entity", "entity_b"), "attribute").where("entity_a <> entity_b")
    return met.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("n_common")).where(F.col("n_common") >= min_overlap)


def mutual_information(joint: DataFrame) -> DataFrame:
    """``dim_a, dim_b, mi, h_a, h_b`` in bits from ``joint(dim_a, dim_b, va, vb, p)``, marginals being its own."""
    pa = joint.groupBy("dim_a", "dim_b", "va").agg(F.sum("p").alias("pa"))
    pb = joint.groupBy("dim_a", "dim_b", "vb").agg(F.sum("p").alias("pb"))
    h = lambda df, c, name: df.groupBy("dim_a", "dim_b").agg(F.sum(F.when(F.col(c) > 0, -F.col(c) * F.log2(c)).otherwise(0.0)).alias(name))
    whole = joint.join(pa, ["dim_a", "dim_b", "va"], "left").join(pb, ["dim_a", "dim_b", "vb"], "left")
    ratio = F.col("p") / (F.coalesce("pa", F.lit(TINY)) * F.coalesce("pb", F.lit(TINY)))
    mi = whole.groupBy("dim_a", "dim_b").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2(ratio)).otherwise(0.0)).alias("mi"))
    return mi.join(h(pa, "pa", "h_a"), ["dim_a", "dim_b"]).join(h(pb, "pb", "h_b"), ["dim_a", "dim_b"])


def redundant_dimensions(joint: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``dimension``: those that another one tells nearly all about; of a pair that tell each other, the second."""
    told = F.when((F.col("h_b") > 0) & (F.col("mi") / F.col("h_b") >= threshold), F.col("dim_b")).when((F.col("h_a") > 0) & (F.col("mi") / F.col("h_a") >= threshold), F.col("dim_a"))
    return mutual_information(joint).select(told.alias("dimension")).where("dimension is not null").distinct()


def _profiles(beliefs: DataFrame) -> DataFrame:
    """One row per entity with its attributes; as many entries as the entity has attributes."""
    return beliefs.groupBy("entity").agg(F.collect_list(F.struct("attribute", "dist", certainty(F.col("dist")).alias("sure"))).alias("known"))


def _places(known: pa.ListArray) -> dict[str, pa.Array]:
    """The values that each attribute takes; their order gives the values their places."""
    entries = known.flatten()
    attributes, dists = entries.field("attribute"), entries.field("dist")
    said = attributes.take(pc.list_parent_indices(dists).cast("int64"))
    values = dists.flatten().field("value")
    return {a: values.filter(pc.equal(said, a)).unique().drop_null() for a in attributes.unique().drop_null().to_pylist()}


class _Side:
    """Entities as arrays by attribute; ``places`` gives the values of an attribute their places."""

    def __init__(self, known: pa.ListArray, places: dict[str, pa.Array]):
        n, entries = len(known), known.flatten()
        of_entry, attributes, dists = pc.list_parent_indices(known).to_numpy(), entries.field("attribute"), entries.field("dist")
        sure, sizes = entries.field("sure").to_numpy(zero_copy_only=False), pc.coalesce(pc.list_value_length(dists), 0).to_numpy()
        of_value, said = pc.list_parent_indices(dists).to_numpy(), dists.flatten()
        values, roots = said.field("value"), np.sqrt(np.maximum(said.field("p").to_numpy(zero_copy_only=False), 0.0))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.has, self.sure, self.single, self.name, self.roots = {}, {}, {}, {}, {}
        for a, ordered in places.items():
            own = pc.fill_null(pc.equal(attributes, a), False).to_numpy(zero_copy_only=False)
            at, picked = of_entry[own], np.flatnonzero(own[of_value])
            codes = pc.fill_null(pc.index_in(values.take(pa.array(picked)), value_set=ordered), -3).to_numpy()
            self.has[a], self.sure[a], self.single[a], self.name[a], self.roots[a] = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros((n, len(ordered)))
            self.has[a][at], self.sure[a][at], self.single[a][at] = 1, sure[own], sizes[own] <= 1
            first = np.full(len(values) + 1, -3)
            first[picked] = codes
            self.name[a][at] = np.where(sizes[own] > 0, first[np.minimum(starts[own], len(values))] + 2, 0)  # values that no query has all differ from theirs
            known_to = codes >= 0
            self.roots[a][of_entry[of_value[picked[known_to]]], codes[known_to]] = roots[picked[known_to]]

    def numbers(self) -> np.ndarray:
        return np.column_stack([x for a in self.has for x in (self.has[a], self.sure[a], self.single[a], self.name[a], self.roots[a])])

    def only(self, rows: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        for field, of in vars(self).items():
            setattr(out, field, {a: x[rows] for a, x in of.items()})
        return out

    def terms(self, least: float, first: bool) -> np.ndarray:
        """Numbers whose products of a row of each side are the weighted coefficients less ``least`` of all weights:
        below 0 if and only if the mean is below ``least``."""
        out = []
        for a in self.has:
            half = self.has[a] * (self.sure[a] / 2 + 0.05)
            own, other = (half, self.has[a]) if first else (self.has[a], half)
            sign = -least if first else 1.0
            out += [self.roots[a] * own[:, None], self.roots[a] * other[:, None], (sign * own)[:, None], (sign * other)[:, None]]
        return np.concatenate(out, axis=1).astype(np.float32)


def _distinct(side: _Side) -> tuple[_Side, np.ndarray, np.ndarray]:
    """Each profile once; where its entities begin in the third, the entities in order of their profiles."""
    rows = np.ascontiguousarray(side.numbers())
    _, first, of = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return side.only(first), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))]), np.argsort(of, kind="stable")


def _exact(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, min_overlap: int) -> np.ndarray:
    """The coupling of entities ``i`` of ``a`` with entities ``j`` of ``b``, pair by pair; 0 where a gate closes."""
    n = clash = telling = total = weights = np.zeros(len(i))
    for k in a.has:
        both = a.has[k][i] * b.has[k][j]
        single = both * a.single[k][i] * b.single[k][j]
        weight = both * ((a.sure[k][i] + b.sure[k][j]) / 2 + 0.1)
        n, telling = n + both, telling + both - single
        clash = clash + single * (a.name[k][i] != b.name[k][j])
        total, weights = total + weight * np.einsum("ij,ij->i", a.roots[k][i], b.roots[k][j]), weights + weight
    opened = (n >= min_overlap) & (clash == 0) & (telling >= max(2, min_overlap - 1))
    return np.where(opened, np.divide(total, weights, out=np.zeros_like(total), where=weights > 0), 0.0)


def _groups(a: _Side, b: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides that can be compared: where an attribute has a single value everywhere, those that share it."""
    fixed = [k for k in a.has if a.single[k].all() and a.has[k].all() and b.single[k].all() and b.has[k].all()]
    if not fixed:
        yield np.arange(len(next(iter(a.has.values())))), np.arange(len(next(iter(b.has.values()))))
        return
    own, other = (np.column_stack([side.name[k] for k in fixed]) for side in (a, b))
    keys, of = np.unique(np.concatenate([own, other]), axis=0, return_inverse=True)
    of_a, of_b = np.split(of.ravel(), [len(own)])
    for g in range(len(keys)):
        rows, others = np.flatnonzero(of_a == g), np.flatnonzero(of_b == g)
        if len(rows) and len(others):
            yield rows, others


def merge_candidates(queries: DataFrame, beliefs: DataFrame, least: float = MERGE, min_overlap: int = MIN_OVERLAP, block_rows: int = 65_536, digits: int | None = None) -> DataFrame:
    """``entity_a, entity_b, coupling`` of the stated query entities with all others whose coupling is at least
    ``least`` (above 0), rounded to ``digits`` if given.

    Exact. Queries go out in blocks of about ``block_rows`` entities; a block passes over all entities once. Equal
    profiles are compared once, by one matrix product; the pairs that it leaves are scored one by one, and leave a
    task as lists of one profile's matches, so no pair is shuffled.
    """
    own = materialize(_profiles(beliefs), "profiles")
    asked = materialize(own.join(queries.select("entity").distinct(), "entity", "left_semi"), "asked")
    blocks = max(1, -(-asked.count() // block_rows))
    kind, found, others = dict(own.dtypes)["entity"], None, spread(own)
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("entity"), F.lit(blocks)) == i).toArrow()
        near = others.mapInArrow(_near(part, least, min_overlap, digits), f"a array<{kind}>, b array<struct<entity_b: {kind}, coupling: double>>")
        found = near if found is None else found.unionAll(near)
    pairs = found.select("a", F.explode("b").alias("b")).select(F.explode("a").alias("entity_a"), "b.entity_b", "b.coupling")
    return pairs.where("entity_a <> entity_b")


#: Profiles of each side that are compared at once, entities of a batch, and about how many of them an answer lists.
TILE, BATCH, MOST = 1_024, 50_000, 1_000_000


def _near(part: pa.Table, least: float, min_overlap: int, digits: int | None):
    def list_of(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def gathered(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the entities of profiles ``rows`` stand, profile after profile."""
        sizes = starts[rows + 1] - starts[rows]
        return np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = part["known"].combine_chunks()
        places = _places(known)
        if not places:
            return
        a, starts_a, order_a = _distinct(_Side(known, places))
        ids = part["entity"].combine_chunks().take(pa.array(order_a))
        for frame in _gathered(batches):
            b, starts_b, order_b = _distinct(_Side(frame["known"].combine_chunks(), places))
            others = frame["entity"].combine_chunks().take(pa.array(order_b))
            terms_a, terms_b = a.terms(least, True), b.terms(least, False)

            def batch_of(i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
                sizes = starts_b[j + 1] - starts_b[j]
                seen, first = np.unique(i, return_index=True)
                met = pa.StructArray.from_arrays([others.take(pa.array(gathered(starts_b, j))), pa.array(np.repeat(scores, sizes))], ["entity_b", "coupling"])
                to_b = np.concatenate([[0], np.cumsum(sizes)])[np.append(first, len(i))]
                to_a = np.concatenate([[0], np.cumsum(starts_a[seen + 1] - starts_a[seen])])
                return pa.RecordBatch.from_arrays([list_of(to_a, ids.take(pa.array(gathered(starts_a, seen)))), list_of(to_b, met)], ["a", "b"])

            for rows, cols in _groups(a, b):
                x, y = terms_a[rows], terms_b[cols]
                used = x.any(0) & y.any(0)
                x, y = np.ascontiguousarray(x[:, used]), np.ascontiguousarray(y[:, used])
                slack = 1e-5 * max(1, len(a.has))  # for the product in single precision; what passes is scored again
                for r in range(0, len(rows), TILE):
                    for c in range(0, len(cols), TILE):
                        i, j = np.nonzero(x[r : r + TILE] @ y[c : c + TILE].T >= -slack)
                        i, j = rows[i + r], cols[j + c]
                        scores = _exact(a, b, i, j, min_overlap)
                        kept = (scores >= least) & (scores > 0)
                        i, j, scores = i[kept], j[kept], scores[kept]
                        if not len(i):
                            continue
                        if digits is not None:
                            scores = np.floor(scores * 10.0**digits + 0.5) / 10.0**digits
                        for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(starts_b[j + 1] - starts_b[j]) // MOST)) + 1):
                            yield batch_of(i[at], j[at], scores[at])

    return near


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BATCH:
            yield pa.Table.from_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)
