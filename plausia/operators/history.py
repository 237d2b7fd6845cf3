"""History of changing attributes: the periods in which each believed value held.

Late or corrected changes rebuild the *affected chains* only: the raw changes of the touched entities are
read, all their intervals are built anew, and the new chains take the place of the old ones in one step, the writing
of a list of what counts.

Building is a sort by (entity, valid time, sequence) into ranges and one pass over each range, so an entity
with a third of all rows spreads over many tasks; what crosses the border of a range is mended from one or
two summary rows per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import fresh_path, materialize, shuffle_partitions
from ..sources.versions import Versions
from .deltas import first_deliveries, top_value, valid_seconds

CHANGES = "dimension_id string, delta_id string, valid_from double, seq long, value string"
CHAINS = "dimension_id string, delta_id string, value string, valid_from double, valid_to double"
_SCANNED = CHAINS + ", kind string, range_no int"
_SCHEMA = pa.schema([("dimension_id", pa.string()), ("delta_id", pa.string()), ("value", pa.string()), ("valid_from", pa.float64()), ("valid_to", pa.float64()), ("kind", pa.string()), ("range_no", pa.int32())])


def comparable(value):
    """Lower case, ``_`` and white space read as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(value), r"[\s_]+", " "))


def raw_changes(deltas: DataFrame) -> DataFrame:
    """The belief changes in a delta log: first deliveries that have a dimension and a top value.

    Rows with a null ``dimension_id``, a null or empty posterior or one of ``unknown`` alone, or neither a
    valid time nor a ``ts`` are no changes. A null ``seq`` counts as 0.
    """
    at = F.coalesce(valid_seconds(F.col("valid_time")), F.col("ts"))
    first = first_deliveries(deltas, "dimension_id", at.alias("valid_from"), top_value(F.col("posterior")).alias("top"))
    held = first.where("dimension_id is not null and valid_from is not null and top is not null")
    return held.select("dimension_id", F.col("id").alias("delta_id"), "valid_from", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), comparable(F.col("top")).alias("value"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Opening rows of one sorted range. ``head``: the range's first row, an opening only if the range before
    ends otherwise; ``pend``: its last opening, whose end lies in a later range; ``headpend``: both."""
    from pyspark import TaskContext

    range_no = TaskContext.get().partitionId()
    held: dict | None = None  # the last opening so far
    last: tuple[str, str] | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        dim, value = batch.column("dimension_id"), batch.column("value")
        opens = [last is None or (dim[0].as_py(), value[0].as_py()) != last]
        if batch.num_rows > 1:
            moved = pc.or_(pc.not_equal(dim.slice(1), dim.slice(0, len(dim) - 1)), pc.not_equal(value.slice(1), value.slice(0, len(value) - 1)))
            mask = pa.concat_arrays([pa.array(opens), moved])
        else:
            mask = pa.array(opens)
        last = (dim[-1].as_py(), value[-1].as_py())
        opening = batch.filter(mask)
        if not opening.num_rows:
            continue
        rows = opening.select(["dimension_id", "delta_id", "value", "valid_from"])
        if held is not None:
            rows = pa.concat_batches([held["row"], rows])
        n = rows.num_rows
        if n > 1:
            dims, start = rows.column(0), rows.column(3)
            same = pc.equal(dims.slice(1), dims.slice(0, n - 1))
            ends = pc.if_else(same, start.slice(1), pa.scalar(None, pa.float64()))
            kinds = ["head" if first else "done"] + ["done"] * (n - 2)
            first = False
            yield pa.record_batch([*(c.slice(0, n - 1) for c in rows.columns), ends, pa.array(kinds, pa.string()), pa.array([range_no] * (n - 1), pa.int32())], schema=_SCHEMA)
        held = {"row": rows.slice(n - 1)}
    if held is not None:
        yield pa.record_batch([*held["row"].columns, pa.nulls(1, pa.float64()), pa.array(["headpend" if first else "pend"]), pa.array([range_no], pa.int32())], schema=_SCHEMA)


def _mend(summary: pa.Table) -> pa.Table:
    """Joins the ranges: at most two rows of each, so the table is bounded by the number of ranges."""
    out, open_row = [], None
    order = {"head": 0, "headpend": 0, "pend": 1}
    rows = sorted(summary.to_pylist(), key=lambda r: (r["range_no"], order[r["kind"]]))
    for r in rows:
        if r["kind"] == "pend":
            open_row = r
            continue
        same_chain = open_row is not None and open_row["dimension_id"] == r["dimension_id"]
        goes_on = same_chain and open_row["value"] == r["value"]
        if goes_on:
            if r["kind"] == "head":
                out.append(open_row | {"valid_to": r["valid_to"]})
                open_row = None
            continue
        if open_row is not None:
            out.append(open_row | {"valid_to": r["valid_from"] if same_chain else None})
        open_row = r if r["kind"] == "headpend" else None
        if r["kind"] == "head":
            out.append(r)
    if open_row is not None:
        out.append(open_row)
    names = ["dimension_id", "delta_id", "value", "valid_from", "valid_to"]
    return pa.Table.from_pylist([{k: r[k] for k in names} for r in out], schema=pa.schema([_SCHEMA.field(k) for k in names]))


def build_chains(changes: DataFrame, path: str | None = None) -> DataFrame:
    """The versions of every entity in ``changes``: a change opens one if it is the entity's first or its
    value differs from the change before; a version ends where the next starts, the last one is open. Of changes
    alike in entity, time and sequence the order is by ``delta_id``. They are written to ``path``."""
    spark = changes.sparkSession
    path = path or fresh_path(spark, "chains")
    order = ["dimension_id", "valid_from", "seq", "delta_id"]
    ranges = changes.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ranges.mapInArrow(_scan, _SCANNED).write.parquet(f"{path}/scanned")
    summary = spark.read.schema(_SCANNED).parquet(f"{path}/scanned").where("kind <> 'done'")
    summary.groupBy(F.lit(0).alias("all")).applyInArrow(_mend, CHAINS).write.parquet(f"{path}/mended")
    return read_chains(spark, path)


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    columns = [c.split(" ")[0] for c in CHAINS.split(", ")]
    scanned = spark.read.schema(_SCANNED).parquet(f"{path}/scanned").where("kind = 'done'").select(*columns)
    return scanned.unionAll(spark.read.schema(CHAINS).parquet(f"{path}/mended"))


class HistoryStore(Versions):
    """Raw changes and version chains in a folder, as a row of batches.

    A batch writes its raw changes, the entities that it touches and their rebuilt chains into a folder of its own;
    the chains of these entities in earlier batches are void from then on, those of others stay as they are. The
    batch counts once the list of live batches has been written. :meth:`compact` writes what is live as one batch.
    """

    def batches(self) -> list[int]:
        """The live batches, oldest first."""
        return [part for part, _ in self.current()]

    def _read(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/b{b}/{name}" for b in batches)) if batches else self.spark.createDataFrame([], schema)

    def raw(self) -> DataFrame:
        return self._read("raw", CHANGES, self.batches())

    def chains(self) -> DataFrame:
        """The versions of all entities, those of an entity from the last batch that touched it."""
        live = self.batches()
        out = self.spark.createDataFrame([], CHAINS)
        for i, b in enumerate(live):
            held = read_chains(self.spark, f"{self.path}/b{b}/chains")
            if later := live[i + 1 :]:
                held = held.join(self._read("touched", "dimension_id string", later).distinct(), "dimension_id", "left_anti")
            out = held if i == 0 else out.unionAll(held)
        return out

    def apply(self, batch: DataFrame) -> None:
        """Adds a batch of raw changes (:func:`raw_changes` gives them): the raw changes of the entities that it
        touches, no others, are read and all their versions built anew.

        A ``delta_id`` already held for the entity is a repeat and adds nothing, so a batch can be applied again.
        """
        live = self.batches()
        number = 1 + max([*live, *(int(n[1:]) for n in self.names() if n[:1] == "b")], default=0)
        at = f"{self.path}/b{number}"
        batch = batch.select(*(c.split(" ")[0] for c in CHANGES.split(", ")))
        if not live:
            batch.write.parquet(f"{at}/raw")
            changes = self._read("raw", CHANGES, [number])
            changes.select("dimension_id").distinct().write.parquet(f"{at}/touched")
        else:
            batch.select("dimension_id").distinct().write.parquet(f"{at}/touched")
            touched = self._read("touched", "dimension_id string", [number])
            old = materialize(self._read("raw", CHANGES, live).join(touched, "dimension_id", "left_semi"), "touched_raw")
            batch.join(old.select("dimension_id", "delta_id"), ["dimension_id", "delta_id"], "left_anti").write.parquet(f"{at}/raw")
            changes = old.unionAll(self._read("raw", CHANGES, [number]))
        build_chains(changes, f"{at}/chains")
        self.commit([(b, 0) for b in (*live, number)])

    def compact(self) -> None:
        """Writes the live batches as one and removes the folders of all that went before."""
        live = self.batches()
        if len(live) > 1:
            number = 1 + max(live)
            at = f"{self.path}/b{number}"
            self.raw().write.parquet(f"{at}/raw")
            self.raw().select("dimension_id").distinct().write.parquet(f"{at}/touched")
            self.chains().select("*", F.lit("done").alias("kind"), F.lit(0).alias("range_no")).write.parquet(f"{at}/chains/scanned")
            self.spark.createDataFrame([], CHAINS).write.parquet(f"{at}/chains/mended")
            self.commit([(number, 0)])
        live = self.batches()
        for name in self.names():
            if name[:1] == "b" and int(name[1:]) not in live:
                self.remove(name)
        self.forget_lists()


def belief_history(deltas: DataFrame, *, late_share: float = 0.125) -> DataFrame:
    """``dimension_id, delta_id, value, valid_from, valid_to``: every version of every dimension.

    The log goes into a :class:`HistoryStore` in two batches as it was ingested: the second, the last ``late_share`` of
    the sequence, holds rows that came late and replaces the chains that it touches; the store is then read.
    """
    changes = materialize(raw_changes(deltas), "changes")
    cut = int((changes.agg(F.max("seq")).first()[0] or 0) * (1 - late_share))
    store = HistoryStore(deltas.sparkSession, label="history")
    store.apply(changes.where(F.col("seq") <= cut))
    store.apply(changes.where(F.col("seq") > cut))
    return store.chains()
