"""Date and time expressions. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITY_TZ = "America/New_York"


def instant(value) -> Column:
    """A timestamp literal from text, or the column itself."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def local_time(ts, tz: str = CITY_TZ) -> Column:
    return F.from_utc_timestamp(_col(ts), tz)


def local_date(ts, tz: str = CITY_TZ) -> Column:
    return F.to_date(local_time(ts, tz))


def local_week(ts, tz: str = CITY_TZ) -> Column:
    """Monday of the local week."""
    return F.to_date(F.date_trunc("week", local_date(ts, tz)))


def whole_days(start, end) -> Column:
    """Whole 24-hour days, truncated toward zero; null when either is null."""
    return F.timestamp_diff("DAY", _col(start), _col(end))


def days_between(start, end) -> Column:
    """Fractional days."""
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(86_400_000_000)


def closing_monday(d) -> Column:
    """Label of a Tuesday-to-Monday week: the Monday that ends it."""
    return F.next_day(F.date_sub(_col(d), 1), "MON")


def month_start(d) -> Column:
    return F.to_date(F.trunc(_col(d), "MM"))


def days_before(as_of, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), instant(as_of))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
