"""The store: tables in a folder, read with their types and written by append or upsert."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .versions import Versions


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its declared types; filters and columns reach the Parquet scan."""
    return spark.read.schema(schema.TABLES[name]).parquet(f"{folder}/{name}.parquet")


class Store:
    """Tables in a folder, each a list of parts. ``append`` adds a part, ``upsert`` writes the merged table as one, and
    then the list is written anew, so a reader or a failed job never sees half of a change."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.folder}/{name}")

    def parts(self, table: str) -> list[int]:
        return [part for part, _ in self._table(table).current()]

    def read(self, table: str) -> DataFrame:
        found = self.parts(table)
        if not found:
            return self.spark.createDataFrame([], schema.TABLES[table])
        return self.spark.read.schema(schema.TABLES[table]).parquet(*(f"{self.folder}/{table}/p{n}" for n in found))

    def _write(self, table: str, rows: DataFrame, keep: list[int]) -> None:
        at = self._table(table)
        number = 1 + max([int(n[1:]) for n in at.names() if n[:1] == "p"], default=0)
        self._typed(table, rows).write.parquet(f"{self.folder}/{table}/p{number}")
        at.commit([(n, 0) for n in (*keep, number)])

    def append(self, table: str, rows: DataFrame) -> None:
        self._write(table, rows, self.parts(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        before = self.parts(table)
        self._write(table, rows, [])
        at = self._table(table)
        for name in at.names():  # the parts before stay for readers that still hold them
            if name[:1] == "p" and int(name[1:]) not in (*before, *self.parts(table)):
                at.remove(name)

    def replace_events(self, rows: DataFrame) -> None:
        """Puts events in the place of those with their ids; of one id given twice the later one by ``ts`` stands."""
        self.upsert("evidence_events", rows, lambda both: both.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*(c for c in both.columns if c not in ("id", "_batch"))), F.struct("_batch", "ts", "text")).alias("r")).select("id", "r.*"))

    def upsert(self, table: str, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        """``merge`` turns old and new rows, told apart by ``_batch`` 0 and 1, into the table."""
        both = self.read(table).withColumn("_batch", F.lit(0)).unionByName(self._typed(table, rows).withColumn("_batch", F.lit(1)))
        self.replace(table, merge(both))

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        names = [c.split(" ")[0] for c in schema.TABLES[table].split(", ")]
        return rows.select(*names)


def latest_dimensions(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per id, the last by ``order``."""
    last = rows.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct(*order)).alias("r"))
    return last.select("id", "r.*")


def merge_edges(rows: DataFrame) -> DataFrame:
    """Greatest confidence, evidence and time of the last, per (source, relation, target)."""
    order = F.struct("_batch", "ts", "evidence")
    return rows.groupBy("source_entity", "relation", "target_entity").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", order).alias("evidence"), F.max_by("ts", order).alias("ts"))


Embedder = Callable[[list[str]], list[list[float] | None]]


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``text_hash, text``: distinct texts whose vector isn't cached."""
    hashed = texts.where("text is not null").select(F.md5("text").alias("text_hash"), "text").dropDuplicates(["text_hash"])
    return hashed.join(cache.select("text_hash"), "text_hash", "left_anti")


def embed_missing(texts: DataFrame, cache: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """The cache with vectors for the texts that it lacked; a batch that fails adds none."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                try:
                    vectors = embedder(list(part["text"]))
                except Exception:  # noqa: BLE001 - one batch must not end the job
                    vectors = [None] * len(part)
                yield pd.DataFrame({"text_hash": part["text_hash"], "embedding": vectors})

    made = missing_texts(texts, cache).mapInPandas(call, schema.EMBEDDINGS).where("embedding is not null")
    return cache.select("text_hash", "embedding").unionByName(made)


def with_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.withColumn("text_hash", F.md5("text")).join(cache, "text_hash", "left")
