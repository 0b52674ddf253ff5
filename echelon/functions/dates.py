"""Dates of races and of snapshots. Nothing here reads the clock: the as-of date is always passed in."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from echelon.functions.columns import text


def as_date(value: Column) -> Column:
    """Date of a date, timestamp or ISO text; null when it cannot be read."""
    return value.try_cast("date")


def as_of(day: str | date) -> Column:
    return F.lit(str(day)).cast("date")


def iso_day(value: Column) -> Column:
    """ISO date of a timestamp-like text; text that is no date is kept, null becomes empty."""
    cleaned = F.trim(text(value))
    return F.coalesce(F.date_format(cleaned.try_cast("timestamp"), "yyyy-MM-dd"), cleaned)


def status_as_of(end_date: Column, day: str | date) -> Column:
    """`completed` once the last race day has passed, else `scheduled`."""
    return F.when(as_date(end_date) < as_of(day), F.lit("completed")).otherwise(F.lit("scheduled"))


def _fragment(part: Column, year: Column) -> Column:
    pieces = r"^\s*([0-9]+)\s*\.\s*([0-9]+)\s*$"
    day, month = F.regexp_extract(part, pieces, 1), F.regexp_extract(part, pieces, 2)
    joined = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((day != "") & (F.length(day) <= 2) & (F.length(month) <= 2), joined.try_cast("date"))


def label_dates(label: Column, year: Column) -> Column:
    """Struct (start_date, end_date, error) of a `dd.mm` or `dd.mm-dd.mm` label.

    An end before its start lies in the next year. A blank label gives null dates; a label
    that cannot be read gives null dates and is named in `error`.
    """
    cleaned = F.trim(text(label))
    parts = F.split(cleaned, "-", 2)
    first = _fragment(parts[0], year)
    last_text = F.coalesce(F.get(parts, F.lit(1)), parts[0])
    same_year = _fragment(last_text, year)
    last = F.when(same_year < first, _fragment(last_text, year + 1)).otherwise(same_year)
    readable = first.isNotNull() & last.isNotNull()
    return F.struct(
        F.when(readable, first).alias("start_date"),
        F.when(readable, last).alias("end_date"),
        F.when((cleaned != "") & ~readable, F.concat(F.lit("Unsupported planning date label: "), cleaned)).alias("error"),
    )
