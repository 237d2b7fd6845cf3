"""Streams: the belief fold with its distributions as state, event-time windows, and a K-slack buffer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..cluster import fresh_path
from ..functions.info import UNKNOWN
from ..operators.beliefs import _step
from ..operators.lateness import K_SECONDS, SECONDS_PER_DAY
from ..schema import DIST_DDL

_LOG = f"entity string, attribute string, seq long, value string, reliability double, prior {DIST_DDL}, posterior {DIST_DDL}, surprise double"
_STATE = "names array<string>, ps array<double>"


def _observe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import math

    dist = list(zip(*state.get, strict=True)) if state.exists else [(UNKNOWN, 1.0)]
    rows = []
    for r in pd.concat(list(frames)).sort_values("seq").itertuples():
        prior = dist
        dist, post, p = _step([(v, float(q)) for v, q in dist], r.value, r.reliability)
        s = 20.0 if p <= 0 else 0.0 if p >= 1 else -math.log2(p)
        shown = [[{"value": v, "p": float(q)} for v, q in d] for d in (prior, post)]
        rows.append((*key, r.seq, r.value, r.reliability, *shown, s))
    state.update(([v for v, _ in dist], [float(q) for _, q in dist]))
    yield pd.DataFrame(rows, columns=["entity", "attribute", "seq", "value", "reliability", "prior", "posterior", "surprise"])


def observe(claims: DataFrame) -> DataFrame:
    """The change log of a stream of claims, in order of arrival by micro-batch and of ``seq`` within one. The
    state per key is its distribution, at most a hundred values."""
    return claims.groupBy("entity", "attribute").applyInPandasWithState(_observe, _LOG, _STATE, "append", GroupStateTimeout.NoTimeout)


def surprise_windows(log: DataFrame, time: str, width: str = "1 day", slide: str | None = None, lateness: str = "3 days") -> DataFrame:
    """Count and sum of surprise per event-time window, tumbling or sliding, final once the watermark has passed."""
    windows = log.withWatermark(time, lateness).groupBy(F.window(time, width, slide) if slide else F.window(time, width))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("surprise").alias("surprise")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "surprise")


def surprise_sessions(log: DataFrame, time: str, key: str, gap: str = "1 hour", lateness: str = "3 days") -> DataFrame:
    """The same per key and session, sessions ending after a gap."""
    sessions = log.withWatermark(time, lateness).groupBy(key, F.session_window(time, gap))
    return sessions.agg(F.count(F.lit(1)).alias("n"), F.sum("surprise").alias("surprise")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "surprise")


_SLACK_OUT = "delta_id string, day int, happened double, kind string"
_SLACK_STATE = "ids array<string>, happened array<double>"


def _buffer(k_seconds: float):
    def play(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day = int(key[0])
        closes = (day + 1) * float(SECONDS_PER_DAY)
        ids, happened = map(list, state.get) if state.exists else ([], [])
        out, release = [], state.hasTimedOut
        if not release:
            rows = pd.concat(list(frames)).sort_values("recorded", kind="stable")
            kept = rows["recorded"] <= closes + k_seconds
            late = rows["recorded"] >= closes
            kinds = ["dropped" if not k else "corrected" if x else "provisional" for k, x in zip(kept, late, strict=True)]
            out = list(zip(rows["delta_id"], [day] * len(rows), rows["happened"], kinds, strict=True))
            ids += rows["delta_id"][kept].tolist()
            happened += rows["happened"][kept].tolist()
            release = not kept.all()
        if release:
            out += [(i, day, h, "final") for h, i in sorted(zip(happened, ids, strict=True))]
            if state.exists:
                state.remove()
        else:
            state.update((ids, happened))
            state.setTimeoutTimestamp(int(max((closes + k_seconds) * 1000, state.getCurrentWatermarkMs() + 1)))
        if out:
            yield pd.DataFrame(out, columns=["delta_id", "day", "happened", "kind"])

    return play


def k_slack_stream(events: DataFrame, slices: int = 64, k_seconds: float = K_SECONDS, disorder: str = "0 seconds") -> DataFrame:
    """A stream of ``delta_id, day, happened, recorded`` through the buffers of its days: rows come out at once as
    ``provisional``, ``corrected`` or ``dropped``, and again as ``final``, in order of happening, when the buffer is
    released: once the watermark, the latest recording seen less ``disorder``, has passed the bound. Then its state goes;
    what is recorded after the bound is dropped by its own time.

    A day is spread over ``slices`` buffers, each a stretch of its hours, so buffers in turn give the order of the day.
    """
    width = float(SECONDS_PER_DAY) / slices
    keyed = events.withColumn("slice", F.floor((F.col("happened") - F.col("day") * float(SECONDS_PER_DAY)) / width).cast("int")).withColumn("recorded_at", F.timestamp_micros((F.col("recorded") * 1_000_000).cast("long")))
    return keyed.withWatermark("recorded_at", disorder).groupBy("day", "slice").applyInPandasWithState(_buffer(k_seconds), _SLACK_OUT, _SLACK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that the stream has now, run through and read back as a table in the shared folder. With
    ``complete`` each micro-batch replaces the table by the whole result."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "drained"), fresh_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(out)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
