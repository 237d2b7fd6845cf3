"""Late and out-of-order events: per-day aggregates by event time under a lateness bound.

K-slack reordering: a day's events stay in a buffer until the bound after the day's end has passed. Then they
are released in event-time order to the final, order-sensitive aggregation. Meanwhile each midnight publishes
provisional values from the buffer. An event recorded after the release is dropped, and reported.

In a batch, events are cut into ranges of (day, time, sequence) and come to each range's buffers in the order of
recording, as they would have arrived. A buffer admits them while its day is open, publishes its size each
midnight, takes corrections until the bound, then releases what it holds in event order to the fold. The partial
aggregates of a day's ranges are merged in their order, so a day with a third of all events is split over
many tasks, and no task holds a day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import shuffle_partitions
from .deltas import SECONDS_PER_DAY, first_deliveries, utc_day, valid_seconds

K_SECONDS = 72 * 3600
_PART = "day int, range_no int, n long, first_key string, last_key string, switches long, first_at double, last_at double, longest_gap double, n_corrected long, n_dropped long, published array<long>"
_PART_TYPE = pa.schema([
    ("day", pa.int32()), ("range_no", pa.int32()), ("n", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("switches", pa.int64()), ("first_at", pa.float64()), ("last_at", pa.float64()),
    ("longest_gap", pa.float64()), ("n_corrected", pa.int64()), ("n_dropped", pa.int64()), ("published", pa.list_(pa.int64())),
])
_OUT = "delta_id string, kind string, " + _PART
_OUT_TYPE = pa.schema([("delta_id", pa.string()), ("kind", pa.string()), *_PART_TYPE])
CORRECTED, DROPPED, PARTIAL = "corrected", "dropped", "partial"


def happenings(deltas: DataFrame) -> DataFrame:
    """``delta_id, key, day, happened, recorded, seq``: first deliveries with a valid time and a recording
    time. A null dimension is the empty key, a null ``seq`` 0."""
    first = first_deliveries(deltas, F.coalesce("dimension_id", F.lit("")).alias("key"), valid_seconds(F.col("valid_time")).alias("happened"), F.col("ts").alias("recorded"))
    return first.where("happened is not null and recorded is not null").select(F.col("id").alias("delta_id"), "key", utc_day(F.col("happened")).alias("day"), "happened", "recorded", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))


def merge_partials(a: dict, b: dict) -> dict:
    """The aggregate of ``a`` followed by ``b``; associative. Either may have released nothing."""
    sums = {k: a[k] + b[k] for k in ("n", "n_corrected", "n_dropped")} | {"published": [x + y for x, y in zip(a["published"], b["published"], strict=True)]}
    if not a["n"] or not b["n"]:
        return (a if a["n"] else b) | sums
    return a | sums | {
        "last_key": b["last_key"], "switches": a["switches"] + b["switches"] + int(a["last_key"] != b["first_key"]),
        "last_at": b["last_at"], "longest_gap": max(a["longest_gap"], b["longest_gap"], b["first_at"] - a["last_at"]),
    }


class Buffers:
    """The buffer of one day at a time, over events that come in the order of recording.

    What it holds is bounded by the range of events that a task plays."""

    def __init__(self, k_seconds: float, range_no: int):
        self.k, self.range_no = k_seconds, range_no
        self.ticks = np.arange(int(k_seconds // SECONDS_PER_DAY) + 1) * float(SECONDS_PER_DAY)
        self.day: int | None = None

    def _open(self, day: int) -> None:
        self.day, self.held, self.published, self.counts = day, [], np.zeros(len(self.ticks), np.int64), [0, 0]

    def admit(self, day: int, at: np.ndarray, recorded: np.ndarray, seq: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, dict | None]:
        """Takes the next events of a day. Gives which of them are late (1 corrected, 2 dropped) and, when another
        day begins, what the buffer of the day before released."""
        released = self.release() if self.day is not None and self.day != day else None
        if self.day != day:
            self._open(day)
        waited = recorded - (day + 1.0) * SECONDS_PER_DAY  # when the event came, after the end of its day
        closed, bound = np.searchsorted(waited, 0.0), np.searchsorted(waited, self.k, "right")
        self.held.append((at[:bound], seq[:bound], key[:bound]))
        self.published += np.searchsorted(waited[:bound], self.ticks)
        self.counts[0] += int(bound - closed)
        self.counts[1] += len(at) - int(bound)
        late = np.zeros(len(at), np.int64)
        late[closed:bound], late[bound:] = 1, 2
        return late, released

    def release(self) -> dict | None:
        """Empties the buffer into the fold, in event order."""
        if self.day is None:
            return None
        at, seq, key = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((seq, at))
        t, k = at[order], key[order]
        out = {
            "day": self.day, "range_no": self.range_no, "n": len(t), "first_key": k[0] if len(t) else None, "last_key": k[-1] if len(t) else None, "switches": int((k[1:] != k[:-1]).sum()),
            "first_at": float(t[0]) if len(t) else None, "last_at": float(t[-1]) if len(t) else None, "longest_gap": float(np.diff(t).max()) if len(t) > 1 else 0.0,
            "n_corrected": self.counts[0], "n_dropped": self.counts[1], "published": self.published.tolist(),
        }
        self.day = None
        return out


def _play(k_seconds: float):
    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        buffers = Buffers(k_seconds, TaskContext.get().partitionId())
        names = np.array([None, CORRECTED, DROPPED], object)
        for batch in batches:
            if not batch.num_rows:
                continue
            day, at, recorded, seq, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("day", "happened", "recorded", "seq", "key"))
            starts = [0, *(np.flatnonzero(np.diff(day)) + 1), len(day)]
            late, done = np.zeros(len(day), np.int64), []
            for a, b in zip(starts, starts[1:], strict=False):
                late[a:b], released = buffers.admit(int(day[a]), at[a:b], recorded[a:b], seq[a:b], key[a:b])
                done += [released] if released else []
            if late.any():
                routed = batch.filter(pa.array(late > 0))
                yield pa.record_batch([routed.column("delta_id"), pa.array(names[late[late > 0]], pa.string()), *(pa.nulls(routed.num_rows, f.type) for f in _PART_TYPE)], schema=_OUT_TYPE)
            if done:
                yield pa.RecordBatch.from_pylist([{"delta_id": None, "kind": PARTIAL} | d for d in done], schema=_OUT_TYPE)
        if last := buffers.release():
            yield pa.RecordBatch.from_pylist([{"delta_id": None, "kind": PARTIAL} | last], schema=_OUT_TYPE)

    return play


def k_slack(events: DataFrame, k_seconds: float = K_SECONDS) -> DataFrame:
    """Plays :func:`happenings` through the buffers: a row per late event (``kind`` ``corrected`` or
    ``dropped``) and the partial aggregates of each day and range (``partial``)."""
    ranges = events.repartitionByRange(shuffle_partitions(events.sparkSession), "day", "happened", "seq").sortWithinPartitions("day", "recorded", "seq")
    return ranges.select("delta_id", "day", "happened", "recorded", "seq", "key").mapInArrow(_play(k_seconds), _OUT)


def _merge_day(parts: pa.Table) -> pa.Table:
    rows = sorted(parts.to_pylist(), key=lambda r: r["range_no"])
    total = rows[0]
    for r in rows[1:]:
        total = merge_partials(total, r)
    return pa.Table.from_pylist([total], schema=_PART_TYPE)


def late_deltas(deltas: DataFrame, k_seconds: float = K_SECONDS) -> DataFrame:
    """``delta_id, kind``: deltas recorded after the UTC day in which they happened, ``corrected`` while the
    day was in the buffer, ``dropped`` beyond. Deltas without a valid time, id or ``ts`` are neither."""
    return k_slack(happenings(deltas), k_seconds).where(F.col("kind") != PARTIAL).select("delta_id", "kind")


def days(deltas: DataFrame, k_seconds: float = K_SECONDS) -> DataFrame:
    """The merged aggregate of each day, with the size of its buffer at each publication."""
    parts = k_slack(happenings(deltas), k_seconds).where(F.col("kind") == PARTIAL).drop("delta_id", "kind")
    return parts.groupBy("day").applyInArrow(_merge_day, _PART).drop("range_no")


def _date(day):
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")


def daily_counts(deltas: DataFrame, k_seconds: float = K_SECONDS) -> DataFrame:
    """One row per day of happening: the final order-sensitive values of its released events, how many of
    them corrected the value published first, how many came too late, and that first value."""
    return days(deltas, k_seconds).select(
        _date(F.col("day")).alias("day"), F.col("n").alias("n_final"), F.col("published")[0].alias("n_first_published"), "n_corrected", "n_dropped",
        F.col("first_key").alias("first_dimension"), F.col("last_key").alias("last_dimension"), F.col("switches").alias("n_switches"), F.round("longest_gap", 3).alias("longest_gap_s"),
    )


def provisional_counts(deltas: DataFrame, k_seconds: float = K_SECONDS) -> DataFrame:
    """``day, published_on, n_so_far``: what each midnight, from the day's end until its release, publishes."""
    step = days(deltas, k_seconds).select("day", F.posexplode("published").alias("step", "n_so_far"))
    return step.select(_date(F.col("day")).alias("day"), _date(F.col("day") + 1 + F.col("step")).alias("published_on"), "n_so_far")
