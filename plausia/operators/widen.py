"""Attribute–value rows into wide tables, by log-structured upserts.

A batch of rows becomes a *run* in a store: one sparse row per entity holding a map of cells, each with its version, and
sorted by entity. Reading and compaction keep the latest version of every cell over all runs; read cells are laid out as
typed columns, one per listed attribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import shuffle_partitions
from ..sources.versions import Versions
from .deltas import top_value

#: The English month names of the accepted date form ``D Month YYYY``.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_INTEGER = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)$"
_DECIMAL = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"
#: A table has columns for at most so many attributes; the list of them is its schema.
MOST_ATTRIBUTES = 2_000


def normal_attribute(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s\-]", "_")), "_+", "_")


def typed(value: Column, value_type: str) -> Column:
    """``value`` (a trimmed string) as the type, null if it isn't readable in an accepted form."""
    plain = F.regexp_replace(value, ",", "")
    if value_type == "bigint":
        return F.when(value.rlike(_INTEGER), plain.try_cast("bigint"))
    if value_type == "double":
        return F.when(value.rlike(_DECIMAL), plain.try_cast("double"))
    if value_type == "boolean":
        low = F.lower(value)
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)
    if value_type == "date":
        dotted, worded = r"^(\d{2})\.(\d{2})\.(\d{4})$", r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$"
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(value, worded, 2)))
        iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value)
        iso = iso.when(value.rlike(dotted), F.regexp_replace(value, dotted, "$3-$2-$1"))
        iso = iso.when(value.rlike(worded) & (month > 0), F.concat_ws("-", F.regexp_extract(value, worded, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(value, worded, 1), 2, "0")))
        return iso.try_cast("date")
    return value


def cells(dimensions: DataFrame, attribute_types: DataFrame) -> DataFrame:
    """``entity, attribute, version, value`` per row of a listed attribute.

    Entity and attribute are read from ``id`` at its last dot; rows whose id is null or has no dot, and
    attributes not listed, give no cell. A removed belief (null distribution) or one without a top value is a
    version with a null value.
    """
    named = dimensions.where(F.col("id").contains(".")).select(
        F.regexp_extract("id", r"(?s)^(.*)\.([^.]*)$", 1).alias("entity"),
        normal_attribute(F.regexp_extract("id", r"(?s)^(.*)\.([^.]*)$", 2)).alias("attribute"),
        F.col("last_accessed").alias("version"),
        F.regexp_replace(top_value(F.col("distribution")), r"^\s+|\s+$", "").alias("value"),
    )
    return named.where(F.col("attribute").isin(list(listed(attribute_types))))


def listed(attribute_types: DataFrame) -> dict[str, str]:
    """The listed attributes with their types, in the order of their names: the wide table's schema."""
    rows = attribute_types.where("attribute is not null").select("attribute", "value_type").distinct().orderBy("attribute").limit(MOST_ATTRIBUTES + 1).collect()
    if len(rows) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes can't be columns of one table")
    return {r["attribute"]: r["value_type"] for r in rows}


def run_of(rows: DataFrame) -> DataFrame:
    """A sparse wide delta: ``entity, cells`` with ``cells`` a map from attribute to (version, value), in order of entity.

    Versions of one cell within a batch collapse before entities are formed, on the map side first, so an
    entity has at most as many cells to collect as there are attributes.
    """
    latest = F.max(F.struct("version", "value")).alias("cell")
    per_cell = rows.groupBy("entity", "attribute").agg(latest)
    sparse = per_cell.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "cell"))).alias("cells"))
    return sparse.repartitionByRange(shuffle_partitions(rows.sparkSession), "entity").sortWithinPartitions("entity")


class CellStore(Versions):
    """Wide deltas in a folder, a sorted run for each batch that was applied; :meth:`compact` merges them into one.

    A reader takes the latest version of every cell over all live runs, so a batch may come in any order and again.
    """

    def runs(self) -> DataFrame:
        live = [run for run, _ in self.current()]
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/run{n}" for n in live)) if live else self.spark.createDataFrame([], RUN)

    def _add(self, run: DataFrame, keep: list[int]) -> None:
        number = 1 + max([n for n, _ in self.current()], default=0)
        run.write.mode("overwrite").parquet(f"{self.path}/run{number}")
        self.commit([(n, 0) for n in (*keep, number)])

    def apply(self, rows: DataFrame) -> None:
        """Adds a batch of :func:`cells` as a run."""
        self._add(run_of(rows), [n for n, _ in self.current()])

    def latest(self, attributes: list[str]) -> DataFrame:
        """``entity`` and one (version, value) column per attribute: the latest version of each cell."""
        if not attributes:
            return self.runs().select("entity").distinct()
        return self.runs().groupBy("entity").agg(*(F.max(F.col("cells")[F.lit(a)]).alias(a) for a in attributes))

    def compact(self) -> None:
        """Merges all runs into one, cell by cell, and removes them."""
        old = [n for n, _ in self.current()]
        if len(old) > 1:
            every = self.runs().select("entity", F.explode("cells").alias("attribute", "cell")).select("entity", "attribute", "cell.version", "cell.value")
            self._add(run_of(every), [])
        live = [n for n, _ in self.current()]
        for name in self.names():
            if name[:3] == "run" and int(name[3:]) not in live:
                self.remove(name)
        self.forget_lists()


RUN = "entity string, cells map<string, struct<version: double, value: string>>"


def stored(dimensions: DataFrame, attribute_types: DataFrame, batch_seconds: float = 90 * 86_400.0) -> CellStore:
    """The dimension rows in a store, in two batches: what was accessed up to ``batch_seconds`` before the last access, then the
    rest."""
    store = CellStore(dimensions.sparkSession, label="cells")
    last = dimensions.agg(F.max("last_accessed")).first()[0]
    late = F.coalesce(F.col("version") > (last or 0.0) - batch_seconds, F.lit(False))
    rows = cells(dimensions, attribute_types)
    store.apply(rows.where(~late))
    store.apply(rows.where(late))
    return store


def wide_table(dimensions: DataFrame, attribute_types: DataFrame) -> DataFrame:
    """One row per entity, also of those with no listed attribute, with a typed column per listed attribute; unreadable and
    absent cells are null."""
    types = listed(attribute_types)
    table = stored(dimensions, attribute_types).latest(list(types))
    named = dimensions.where(F.col("id").contains(".")).select(F.regexp_extract("id", r"(?s)^(.*)\.([^.]*)$", 1).alias("entity")).distinct()
    table = named.join(table, "entity", "left")
    return table.select("entity", *(typed(F.col(a)["value"], t).alias(a) for a, t in types.items()))


def unreadable_cells(dimensions: DataFrame, attribute_types: DataFrame) -> DataFrame:
    """``entity, attribute`` of cells whose current value isn't readable as the attribute's type."""
    types = listed(attribute_types)
    table = stored(dimensions, attribute_types).latest(list(types))
    bad = F.array_compact(F.array(*(F.when(F.col(a)["value"].isNotNull() & typed(F.col(a)["value"], t).isNull(), F.lit(a)) for a, t in types.items()))) if types else F.array().cast("array<string>")
    return table.select("entity", F.explode(bad).alias("attribute"))
