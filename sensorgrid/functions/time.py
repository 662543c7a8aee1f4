"""Time expressions. The session zone is UTC, so stored timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch (works on both timestamp types)."""
    return F.unix_timestamp(ts)


def hour_of(ts: Column) -> Column:
    """Timestamp cut to the hour."""
    return F.date_trunc("hour", ts)


def utc_to_local(ts: Column, zone: str) -> Column:
    """Wall-clock time in `zone` of a UTC timestamp."""
    return F.from_utc_timestamp(ts, zone)


def local_to_utc(ts: Column, zone: str) -> Column:
    """UTC timestamp of a wall-clock time in `zone`."""
    return F.to_utc_timestamp(ts, zone)
