"""References to records that do not exist.

Keys are dictionary-encoded as integers within hash ranges of the key space, each range holding one
compressed bitmap per referencing period and one per set of parents; ``reference AND NOT parent`` leaves the
orphans, whose surviving bits are decoded to keys and joined back to the rows that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize
from .bitmaps import Bitmap
from .deltas import first_deliveries, nonblank, utc_month

_DIMENSIONS, _DELTAS = 0, 1
_PARENT, _REFERENCE = 0, 1
_ORPHANS = "space int, key string, month string, kind string, parent_seq long"


def dimension_states(dimensions: DataFrame) -> DataFrame:
    """``key, alive`` per dimension id; the row with the greatest ``last_accessed`` says whether it lives.

    Rows without an id are ignored, a null ``last_accessed`` counts as the oldest, and of rows equally recent
    one that lives wins.
    """
    state = F.max(F.struct("last_accessed", F.col("distribution").isNotNull().cast("int").alias("alive")))
    return dimensions.where("id is not null").groupBy(F.col("id").alias("key")).agg(state["alive"].alias("alive"))


def _orphans_of_range(arrival_width: int):
    def orphans(table: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        space = table["space"].to_numpy()
        for s in np.unique(space):
            part = table.filter(pa.array(space == s))
            keys = pc.dictionary_encode(part["key"]).combine_chunks()
            if isinstance(keys, pa.ChunkedArray):
                keys = keys.chunk(0)
            code, names = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64), keys.dictionary
            is_ref = part["role"].to_numpy() == _REFERENCE
            number = part["number"].to_numpy(zero_copy_only=False)
            parents, held = code[~is_ref], number[~is_ref]
            known = Bitmap.of(parents)
            months = pc.dictionary_encode(pc.fill_null(part["month"], "")).combine_chunks()
            if isinstance(months, pa.ChunkedArray):
                months = months.chunk(0)
            month_code, month_names = months.indices.to_numpy(zero_copy_only=False), months.dictionary.to_pylist()
            parent_seq = np.full(len(names), -1, np.int64)
            if s == _DIMENSIONS:
                alive = Bitmap.of(parents[held == 1])
            else:
                parent_seq[parents] = held
            for m in np.unique(month_code[is_ref]):
                here = is_ref & (month_code == m)
                refs = Bitmap.of(code[here])
                found = [("missing", refs.and_not(known).codes())]
                if s == _DIMENSIONS:
                    found.append(("deleted", (refs & known).and_not(alive).codes()))
                else:
                    found.append(("later", _later(code[here], number[here], parents, held, parent_seq, arrival_width)))
                for kind, codes in found:
                    if len(codes):
                        out.append(pa.table({
                            "space": pa.array(np.full(len(codes), s, np.int32)),
                            "key": names.take(pa.array(codes.astype(np.int64))),
                            "month": pa.array([month_names[m] or None] * len(codes), pa.string()),
                            "kind": pa.array([kind] * len(codes), pa.string()),
                            "parent_seq": pa.array(parent_seq[codes.astype(np.int64)]),
                        }))
        if not out:
            return pa.table({"space": pa.array([], pa.int32()), "key": pa.array([], pa.string()), "month": pa.array([], pa.string()), "kind": pa.array([], pa.string()), "parent_seq": pa.array([], pa.int64())})
        return pa.concat_tables(out)

    return orphans


def _later(code: np.ndarray, seq: np.ndarray, parents: np.ndarray, arrived: np.ndarray, parent_seq: np.ndarray, width: int) -> np.ndarray:
    """Codes some reference of which came before its parent did.

    Arrival periods are runs of ``width`` sequence numbers. Parents gather in a running bitmap, period by
    period; a reference whose parent is not in it yet, though known, came first. Within one period the
    sequence numbers themselves decide.
    """
    period, parent_period = seq // width, arrived // width
    everyone, so_far, done, late = Bitmap.of(parents), Bitmap(), -1, Bitmap()
    for p in np.unique(period):
        so_far |= Bitmap.of(parents[(parent_period > done) & (parent_period <= p)])
        done, here = p, period == p
        late |= (Bitmap.of(code[here]) & everyone).and_not(so_far)
        late |= Bitmap.of(code[here & (parent_seq[code] // width == p) & (parent_seq[code] > seq)])
    return late.codes()


def broken_references(deltas: DataFrame, dimensions: DataFrame, *, keys_per_range: int = 32_768, arrival_periods: int = 64) -> DataFrame:
    """``delta_id, ref_field, kind, month_utc``: one row per delta and broken reference.

    ``kind`` of a ``dimension_id`` is ``missing`` or ``deleted``, of a ``cascaded_from`` ``missing`` or
    ``later``. Null references and a blank ``cascaded_from`` are none; a null ``ts`` gives a null month and a
    null ``seq`` counts as 0; repeated deliveries count once; other columns are not read. Empty tables give no rows (or every reference as missing).
    """
    nodes = materialize(first_deliveries(deltas, "dimension_id", nonblank(F.col("cascaded_from")).alias("cascaded_from"), utc_month(F.col("ts")).alias("month")).withColumn("seq", F.coalesce("seq", F.lit(0))), "nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top")).first()
    ranges = max(1, -(-2 * size["n"] // keys_per_range))
    width = max(1, (size["top"] or 0) // arrival_periods + 1)

    def entries(df: DataFrame, space: int, role: int) -> DataFrame:
        return df.select(F.lit(space).alias("space"), "key", F.lit(role).alias("role"), "month", F.col("number").cast("long").alias("number"))

    none = F.lit(None).cast("string").alias("month")
    named = nodes.where("dimension_id is not null").groupBy(F.col("dimension_id").alias("key"), "month").agg(F.lit(0).alias("number"))
    caused = nodes.where("cascaded_from is not null").groupBy(F.col("cascaded_from").alias("key"), "month", F.floor(F.col("seq") / width).alias("period")).agg(F.min("seq").alias("number"))
    encoded = (
        entries(named, _DIMENSIONS, _REFERENCE)
        .unionAll(entries(caused, _DELTAS, _REFERENCE))
        .unionAll(entries(dimension_states(dimensions).select("key", none, F.col("alive").alias("number")), _DIMENSIONS, _PARENT))
        .unionAll(entries(nodes.select(F.col("id").alias("key"), none, F.col("seq").alias("number")), _DELTAS, _PARENT))
        .withColumn("key_range", F.pmod(F.xxhash64("space", "key"), F.lit(ranges)))
    )
    orphans = materialize(encoded.groupBy("key_range").applyInArrow(_orphans_of_range(width), _ORPHANS), "orphans")

    def rows(space: int, field: str) -> DataFrame:
        lost = orphans.where(F.col("space") == space).alias("o")
        held = nodes.where(F.col(field).isNotNull()).alias("n")
        match = (F.col(f"n.{field}") == F.col("o.key")) & F.col("n.month").eqNullSafe(F.col("o.month"))
        match = match & ((F.col("o.kind") != "later") | (F.col("n.seq") < F.col("o.parent_seq")))
        return held.join(lost, match).select(F.col("n.id").alias("delta_id"), F.lit(field).alias("ref_field"), F.col("o.kind").alias("kind"), F.col("n.month").alias("month_utc"))

    return rows(_DIMENSIONS, "dimension_id").unionAll(rows(_DELTAS, "cascaded_from"))


def orphan_counts(deltas: DataFrame, dimensions: DataFrame, **options: int) -> DataFrame:
    """``table_name, kind, month_utc, n_references``: broken references per table referred to and month."""
    table = F.when(F.col("ref_field") == "dimension_id", "dimensions").otherwise("deltas")
    found = broken_references(deltas, dimensions, **options)
    return found.groupBy(table.alias("table_name"), "kind", "month_utc").agg(F.count(F.lit(1)).alias("n_references"))
