"""Instants are epoch microseconds (bigint) inside the library; timestamps only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
MINUTE = 60 * US
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def lit(value: int) -> Column:
    return F.lit(value).cast("bigint")


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp, read as UTC when it has no zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def instant(us: Column | str) -> Column:
    return F.timestamp_micros(F.col(us) if isinstance(us, str) else us)


def format_utc(us: Column | str) -> Column:
    """Fixed-width UTC text with microseconds, such as 2026-01-02T03:04:05.000000Z."""
    return F.date_format(instant(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def floor_to(us: Column, step: int) -> Column:
    return us - F.pmod(us, lit(step))


def bucket(us: Column, step: int, origin: int = 946_684_800 * US) -> Column:
    """Start of the stride that holds `us`, counted from `origin` (2000-01-01 UTC)."""
    return us - F.pmod(us - lit(origin), lit(step))


def hour_of_day(us: Column) -> Column:
    return F.floor(F.pmod(us, lit(DAY)) / HOUR).cast("bigint")


def day_of_week(us: Column) -> Column:
    """Monday is 0; the epoch was a Thursday."""
    return F.pmod(F.floor(us / DAY) + 3, F.lit(7)).cast("bigint")


def day_index(us: Column, day0: Column) -> Column:
    """Whole days since `day0`."""
    return F.floor((us - day0) / DAY).cast("bigint")


def millis_between(start: Column, end: Column) -> Column:
    return (end - start) / F.lit(1000.0)
