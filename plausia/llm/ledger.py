"""Duplicates hidden by formatting differences.

Turns are reduced to a canonical key. A ledger, bucketed by key, holds each key's count of copies and its
earliest representative. A batch is counted by itself first, then joined in full with the buckets it touches:
counts add up and the smaller representative stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, shuffle_partitions
from ..sources.versions import Versions

#: A ledger has so many buckets of keys, the unit that a batch reads and rewrites.
BUCKETS = 64
_LONGEST_NAME = 60


def letters(c: Column) -> Column:
    """Letters and digits in lower case and in order."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _fields(text: Column) -> Column:
    return F.filter(F.split(text, r"[;|\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")


_FIELD = r"(?s)^[^:=]*[\p{L}\p{N}][^:=]*[:=].*[\p{L}\p{N}].*$"


def is_fields(text: Column) -> Column:
    """Whether the text is made only of two or more ``key: value`` or ``key=value`` fields."""
    return (F.size(_fields(text)) >= 2) & F.forall(_fields(text), lambda x: x.rlike(_FIELD))


def canonical(events: DataFrame) -> DataFrame:
    """``id, speaker_key, text_key``.

    A blank speaker counts as null. A name before the first colon of the text is the speaker if the speaker is
    null (and the name has at most 60 characters) or reads the same; but not if the text is made of fields
    whose first would lose its key by that. The fields of such a text are put in order. Events with a null id
    or text are left out; a text without letters and digits is an empty one.
    """
    name = F.when(F.instr("text", ":") > 0, F.substring_index("text", ":", 1))
    held = events.where("id is not null and text is not null").select("id", "text", F.when(letters(F.col("speaker")) != "", letters(F.col("speaker"))).alias("spoken"), name.alias("name"))
    held = held.withColumn("rest", F.expr("substring(text, length(name) + 2)")).withColumn("named", letters(F.col("name")))
    own_field = is_fields(F.col("text")) & ~F.element_at(F.concat(_fields(F.col("rest")), F.array(F.lit(""))), 1).rlike(_FIELD)
    prefixed = F.when(F.col("spoken").isNull(), (F.length("name") <= _LONGEST_NAME) & (F.col("named") != "") & ~own_field).otherwise(F.col("named") == F.col("spoken"))
    body = held.select("id", F.when(prefixed, F.coalesce("spoken", "named")).otherwise(F.col("spoken")).alias("speaker_key"), F.when(prefixed, F.col("rest")).otherwise(F.col("text")).alias("body"))
    ordered = F.array_join(F.array_sort(F.transform(_fields(F.col("body")), letters)), "")
    return body.select("id", "speaker_key", F.when(is_fields(F.col("body")), ordered).otherwise(letters(F.col("body"))).alias("text_key"))


def keyed(events: DataFrame) -> DataFrame:
    """``id, bucket, key``; the key is 128 bits of a hash of speaker and text."""
    key = F.unhex(F.md5(F.concat(F.coalesce("speaker_key", F.lit("")), F.lit("\u0001"), "text_key")))
    return canonical(events).select("id", key.alias("key")).select("id", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"), "key")


def count_batch(batch: DataFrame) -> DataFrame:
    """``bucket, key, n, keep_id`` of one batch of :func:`keyed` rows."""
    return batch.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id"))


class Ledger(Versions):
    """Counts of canonical keys in a folder, split into buckets of keys.

    A batch is counted, then joined in full with the buckets that it touches, which are written anew; other buckets stay
    as they are, and are neither read nor written.
    """

    def buckets(self, wanted: list[int] | None = None) -> DataFrame:
        """``bucket, key, n, keep_id`` of the given buckets, or all."""
        live = [(b, v) for b, v in self.current() if wanted is None or b in wanted]
        paths = [f"{self.path}/version={v}/bucket={b}" for b, v in live]
        return self.spark.read.schema(LEDGER).option("basePath", self.path).parquet(*paths).select(*LEDGER_COLUMNS) if paths else self.spark.createDataFrame([], LEDGER)

    def add(self, counts: DataFrame) -> None:
        """Adds a counted batch (:func:`count_batch`): counts add up and the smaller representative stays."""
        counts = materialize(counts, "counts")
        touched = sorted(r["bucket"] for r in counts.select("bucket").distinct().collect())  # at most as many as there are buckets
        live = dict(self.current())
        o, c = self.buckets(touched).alias("o"), counts.alias("c")
        joined = o.join(c, (F.col("o.bucket") == F.col("c.bucket")) & (F.col("o.key") == F.col("c.key")), "full_outer")
        merged = joined.select(
            F.coalesce("o.bucket", "c.bucket").alias("bucket"), F.coalesce("o.key", "c.key").alias("key"),
            (F.coalesce("o.n", F.lit(0)) + F.coalesce("c.n", F.lit(0))).alias("n"), F.least("o.keep_id", "c.keep_id").alias("keep_id"),
        ) if live else counts
        version = 1 + max([*live.values(), *(int(n[8:]) for n in self.names() if n[:8] == "version=")], default=0)
        merged.repartitionByRange(shuffle_partitions(self.spark), "bucket", "key").write.partitionBy("bucket").parquet(f"{self.path}/version={version}")
        self.commit(list((live | dict.fromkeys(touched, version)).items()))

    def compact(self) -> None:
        """Removes the versions of buckets that no longer count."""
        live = set(self.current())
        for name in self.names():
            if name[:8] == "version=":
                for bucket in self.names(name):
                    if bucket[:7] == "bucket=" and (int(bucket[7:]), int(name[8:])) not in live:
                        self.remove(f"{name}/{bucket}")
        self.forget_lists()


LEDGER = "bucket int, key binary, n long, keep_id string"
LEDGER_COLUMNS = [c.split(" ")[0] for c in LEDGER.split(", ")]


def _entered(batches: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    rows = [materialize(keyed(b), "keyed") for b in batches]
    ledger = Ledger(batches[0].sparkSession, label="ledger")
    for r in rows:
        ledger.add(count_batch(r))
    return reduce(DataFrame.unionAll, rows), ledger.buckets()


def ledger_of(batches: list[DataFrame]) -> DataFrame:
    """``keep_id, n``: one row per distinct record with its number of copies, after all batches."""
    return _entered(batches)[1].select("keep_id", "n")


def copies(batches: list[DataFrame]) -> DataFrame:
    """``keep_id, copy_id``: each further copy with the record kept in its place."""
    rows, ledger = _entered(batches)
    repeated = ledger.where("n > 1").select("key", "keep_id")
    return rows.join(repeated, "key").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
