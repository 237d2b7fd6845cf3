"""Relative time expressions resolved against the day of a turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of weekdays (Monday first) and of numbers.
WEEKDAYS = [("mon", 0), ("monday", 0), ("tue", 1), ("tues", 1), ("tuesday", 1), ("wed", 2), ("wednesday", 2), ("thu", 3), ("thur", 3), ("thurs", 3), ("thursday", 3), ("fri", 4), ("friday", 4), ("sat", 5), ("saturday", 5), ("sun", 6), ("sunday", 6)]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
_NUMBER = r"(\d+|" + "|".join(NUMBERS) + ")"


def _iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _month(day: Column) -> Column:
    return F.date_format(day, "MMMM yyyy")


def _number(raw: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, NUMBERS)), raw).cast("int")
    return F.coalesce(raw.try_cast("int"), F.when(named > 0, named))


def annotations(text: Column, day: Column) -> Column:
    """``expression = meaning`` of each expression in the text, distinct, in the order of the rules; an empty
    array without a day."""
    low = F.lower(text)
    phrases = [
        ("today", _iso(day)), ("yesterday", _iso(F.date_sub(day, 1))), ("tomorrow", _iso(F.date_add(day, 1))),
        ("last week", F.concat(_iso(F.date_sub(day, 7)), F.lit(" to "), _iso(F.date_sub(day, 1)))), ("next week", F.concat(_iso(F.date_add(day, 1)), F.lit(" to "), _iso(F.date_add(day, 7)))),
        ("this month", _month(day)), ("last month", _month(F.add_months(day, -1))), ("next month", _month(F.add_months(day, 1))),
        ("last year", (F.year(day) - 1).cast("string")), ("this year", F.year(day).cast("string")), ("next year", (F.year(day) + 1).cast("string")),
    ]
    said = lambda label, value: F.concat(F.lit(label + " = "), value)
    found = [F.when(F.contains(low, F.lit(p)), said(p, v)) for p, v in phrases]
    of_week = F.weekday(day)
    for name, number in WEEKDAYS:
        back, ahead = F.pmod(of_week - number, F.lit(7)), F.pmod(number - of_week, F.lit(7))
        week = lambda n: F.when(n == 0, 7).otherwise(n)
        found.append(F.when(low.rlike(rf"\blast\s+{name}\b"), said(f"last {name}", _iso(F.date_sub(day, week(back))))))
        found.append(F.when(low.rlike(rf"\bnext\s+{name}\b"), said(f"next {name}", _iso(F.date_add(day, week(ahead))))))
    ago, weekends = rf"\b{_NUMBER}\s+(days?|weeks?|months?|years?)\s+ago\b", rf"\b{_NUMBER}\s+weekends?\s+ago\b"
    spans = F.arrays_zip(F.regexp_extract_all(low, F.lit(ago), F.lit(1)).alias("n"), F.regexp_extract_all(low, F.lit(ago), F.lit(2)).alias("unit"))

    def before(x: Column) -> Column:
        n, unit = _number(x["n"]), x["unit"]
        value = F.when(unit.startswith("day"), _iso(F.date_sub(day, n))).when(unit.startswith("week"), _iso(F.date_sub(day, n * 7))).when(unit.startswith("month"), _month(F.add_months(day, -n))).otherwise((F.year(day) - n).cast("string"))
        return F.when(n > 0, F.concat(x["n"], F.lit(" "), unit, F.lit(" ago = "), value))

    back = F.transform(F.regexp_extract_all(low, F.lit(weekends), F.lit(1)), lambda n: F.when(_number(n) > 0, F.concat(n, F.lit(" weekends ago = "), _iso(F.date_sub(day, _number(n) * 7)))))
    every = F.array_distinct(F.array_compact(F.concat(F.array(*found), F.transform(spans, before), back)))
    return F.when(day.isNull(), F.array().cast("array<string>")).otherwise(every)


def event_day(ts: Column) -> Column:
    """The UTC day of a turn; null without a plausible time."""
    return F.when(ts > 1_000_000, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86_400.0).cast("int")))


def evidence_line(text: Column, ts: Column) -> Column:
    """The turn as evidence: its date before, what its time expressions mean behind."""
    day, notes = event_day(ts), annotations(F.trim(text), event_day(ts))
    return F.concat(F.coalesce(F.concat(F.lit("["), _iso(day), F.lit("] ")), F.lit("")), F.trim(text), F.when(F.size(notes) > 0, F.concat(F.lit(" (Temporal normalization: "), F.array_join(notes, "; "), F.lit(")"))).otherwise(""))
