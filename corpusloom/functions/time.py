"""Dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """A date from its ISO form with two-digit month and day; null for anything else."""
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text), "yyyy-MM-dd")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days from one moment to another, rounded down, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))).cast("int")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def expired(moment: Column, now: Column, days: int) -> Column:
    """Older than so many days. Null moments never expire."""
    return F.coalesce(moment < now - F.make_interval(days=F.lit(days)), F.lit(False))


def truncated_percent(part: Column, whole: Column) -> Column:
    return (part / F.nullif(whole, F.lit(0)) * 100).cast("int")
