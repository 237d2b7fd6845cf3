"""Streams over the supplied tables, drained to tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import fresh_path
from ..functions import info
from ..operators import lateness
from ..streaming import ingest
from .belief_plans import ORACLE_SQL as BELIEF_SQL
from .belief_plans import order_claims
from .problems import ORACLE_SQL as PROBLEM_SQL
from .problems import Query, table


def _streamed(df: DataFrame) -> DataFrame:
    """A stream that reads ``df`` from files."""
    spark = df.sparkSession
    path = fresh_path(spark, "feed")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def stream1_change_log(spark: SparkSession, d: str) -> DataFrame:
    log = ingest.drained(ingest.observe(_streamed(order_claims(spark, d))))
    p = lambda c: F.round(info.probability(F.col(c), F.col("value"), 0.0), 6)
    return log.select("entity", "seq", "value", p("prior").alias("p_before"), p("posterior").alias("p_after"), F.size("posterior").cast("long").alias("n_values"), F.round("surprise", 6).alias("surprise"))


def stream2_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("surprise"))
    windows = ingest.drained(ingest.surprise_windows(_streamed(events), "t", "2 days", "1 day"), "complete")
    return windows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("surprise", 3).alias("surprise"))


def stream3_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("t"), F.col("user_id").alias("user_id"), F.col("value").alias("surprise"))
    sessions = ingest.drained(ingest.surprise_sessions(_streamed(events), "t", "user_id", "6 hours"), "complete")
    return sessions.select("user_id", F.unix_micros("start").alias("start_us"), "n", F.round("surprise", 3).alias("surprise"))


def stream4_k_slack(spark: SparkSession, d: str) -> DataFrame:
    events = lateness.happenings(table(spark, d, "deltas")).select("delta_id", "day", "happened", "recorded")
    out = ingest.drained(ingest.k_slack_stream(_streamed(events)))
    return out.where("kind <> 'provisional'").select("delta_id", "kind")


QUERIES: dict[str, Query] = {f.__name__: f for f in (stream1_change_log, stream2_windows, stream3_sessions, stream4_k_slack)}
ORACLE_SQL = {
    "stream1_change_log": BELIEF_SQL["upd8_change_log"].replace(", n = max(n) OVER (PARTITION BY entity) AS last FROM", " FROM"),
    "stream2_windows": "SELECT strftime(CAST(day AS DATE) - k, '%Y-%m-%d') AS start, count(*) AS n, round(sum(value), 3) AS surprise FROM (SELECT date_trunc('day', ts) AS day, value, UNNEST([0, 1]) AS k FROM events) GROUP BY ALL",
    "stream3_sessions": """WITH g AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 3) AS surprise FROM s GROUP BY user_id, k""",
    "stream4_k_slack": PROBLEM_SQL["p5_found"] + " UNION ALL SELECT delta_id, 'final' AS kind FROM k WHERE kind <> 'dropped' AND closes + 259200 < (SELECT max(ts) FROM e)",
}
