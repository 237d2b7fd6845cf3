"""Readings of the raw delta log that every operator on it shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
#: Valid times up to this are placeholders; from MILLIS_FROM on they are in milliseconds.
PLACEHOLDER_UP_TO = 1_000_000.0
MILLIS_FROM = 1e11


def nonblank(c: Column) -> Column:
    """Null for a null or blank string, otherwise the string as written."""
    return F.when(F.trim(F.regexp_replace(c, r"\s", " ")) != "", c)


def valid_seconds(c: Column) -> Column:
    """A ``valid_time`` in epoch seconds; null for null, NaN and placeholders."""
    t = F.when(c.isNull() | F.isnan(c) | (c <= PLACEHOLDER_UP_TO), None).otherwise(c)
    return F.when(t >= MILLIS_FROM, t / 1000.0).otherwise(t)


def utc_day(seconds: Column) -> Column:
    """Days since 1970-01-01 UTC, whatever the session's time zone."""
    return F.floor(seconds / F.lit(float(SECONDS_PER_DAY))).cast("int")


def utc_month(seconds: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), utc_day(seconds)), "yyyy-MM")


def top_value(dist: Column) -> Column:
    """The value of greatest ``p`` other than ``unknown``, the first one on ties; null if there is none."""
    known = F.filter(dist, lambda x: x["value"].isNotNull() & (x["value"] != "unknown") & x["p"].isNotNull() & ~F.isnan(x["p"]))
    best = F.array_max(F.transform(known, lambda x: x["p"]))
    return F.try_element_at(F.filter(known, lambda x: x["p"] == best), F.lit(1))["value"]


def first_deliveries(deltas: DataFrame, *columns: Column | str) -> DataFrame:
    """One row per delta ``id``: the delivery with the smallest ``seq`` (rows without an id are no deltas).

    The rank filter lets Spark keep one row per id and task before the shuffle, so an id delivered again and
    again sends no more than a row from each task.
    """
    w = Window.partitionBy("id").orderBy(F.col("seq").asc_nulls_last())
    read = deltas.where(F.col("id").isNotNull()).select("id", "seq", *columns)
    return read.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
