"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz column, without passing through a zoned timestamp."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (ts - origin).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def plus_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"interval '{int(seconds)}' second")


def minus_days(ts: Column, days: int) -> Column:
    return ts - F.expr(f"interval '{int(days)}' day")


def instant(ts: Column) -> Column:
    """A zoned timestamp for watermarks: the wall time read as UTC."""
    return F.timestamp_micros(epoch_us(ts))


def wall_time(moment: Column) -> Column:
    """Inverse of ``instant``."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.unix_micros(moment) * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"))
