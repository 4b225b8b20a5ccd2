"""Tolerant timestamps and the few formats in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Date forms tried, in this order, after the ISO forms.
DATE_FORMS = [
    "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy", "d.M.yyyy", "dd-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy",
]


def parse_time(c: Column, forms: list[str] = DATE_FORMS) -> Column:
    """Timestamp of a text in an ISO form or one of ``forms``; null when none fits, and for a time without
    a day, which would mean another moment every day."""
    found = F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in forms])
    return F.when(~c.cast("string").rlike(r"^\s*T?[0-9]{1,2}:"), found)


def iso(c: Column) -> Column:
    """2024-01-31T23:59:59."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def stamp(c: Column) -> Column:
    """20240131_235959, the form used in file names."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.timestamp_diff("SECOND", start, end)


def minutes_before(c: Column, minutes: int) -> Column:
    return c - F.expr(f"INTERVAL {int(minutes)} MINUTES")
