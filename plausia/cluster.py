"""What operators need from the cluster: the shared folder, written intermediates, partition counts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` of the session, as the cluster names it. Where it is unset and the master is local
    (tests on one machine) a temporary folder is made and set as the checkpoint directory; elsewhere that is
    an error, as executors could not read what others write.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("plausia.shared.dir", None)
    if not own:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        own = "file://" + tempfile.mkdtemp(prefix="plausia-")
        spark.conf.set("plausia.shared.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed with the other intermediates."""
    path = f"{shared_dir(spark)}/plausia-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage (a lost executor costs a re-read, not a re-run) and lets several consumers share one
    computation. The files go when the process ends, or earlier with :func:`release`.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes every intermediate written so far; frames that still read them become unusable."""
    while _written:
        owner, path = _written.pop()
        try:
            remove_path(owner, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


@atexit.register
def _clean_up() -> None:
    for owner, path in _written:
        try:
            if owner.sparkContext._jsc is not None and owner.sparkContext._gateway.proc.poll() is None:
                remove_path(owner, path)
        except Exception:  # noqa: BLE001
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs more than a shuffle of its
    rows. Reads of large tables have more splits than that and stay as they are. For plain scans only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: A broadcast side takes at most so many bytes, written as JSON.
MOST_BYTES = 32_000_000


def is_small(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows of ``most_bytes`` in all, reading no more than that many and one."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
    n, held = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return n <= most_rows and held <= most_bytes


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hints a broadcast only after rows and bytes have been checked; otherwise the join shuffles."""
    return F.broadcast(df) if is_small(df, most_rows) else df


def among(df: DataFrame, of: Column, keys: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df`` with ``_among``: true where ``of`` is one of the ``keys`` (one column), and hardly elsewhere, as only hashes are
    compared. They are broadcast after a size check; with more keys than that it is true for all rows, so this spares work
    but decides nothing."""
    hashes = materialize(keys.select(F.xxhash64(keys.columns[0]).alias("_hash")).distinct(), "hashes")
    if not is_small(hashes, most_rows):
        return df.withColumn("_among", F.lit(True))
    found = df.withColumn("_of", F.xxhash64(of)).join(F.broadcast(hashes), F.col("_of") == F.col("_hash"), "left")
    return found.withColumn("_among", F.col("_hash").isNotNull()).drop("_of", "_hash")
