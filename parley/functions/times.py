"""Exact epoch microseconds and their text form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
# Fixed value: shown for a time that is not a number.
INVALID = "Invalid Timestamp"


def epoch_us(ts: Column) -> Column:
    """'1234567890.000100' -> 1234567890000100; NULL when it is not a number."""
    return (ts.try_cast("decimal(20,6)") * F.lit(1_000_000)).cast("bigint")


def ntz_us(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ, whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def to_ntz(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def ts_text(us: Column) -> Column:
    """Microseconds -> '1234567890.000100'."""
    million = F.lit(1_000_000)
    text = F.format_string("%d.%06d", F.floor(us / million), F.pmod(us, million))
    return F.when(us.isNotNull(), text)


def datetime_text(us: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS' in UTC, independent of the session zone."""
    return F.coalesce(F.substring(to_ntz(us).cast("string"), 1, 19), F.lit(INVALID))


def date_text(us: Column) -> Column:
    """Partition date of a message, 'YYYY-MM-DD' in UTC."""
    return F.substring(to_ntz(us).cast("string"), 1, 10)


def age_hours(as_of_us: int, us: Column) -> Column:
    return F.round((F.lit(as_of_us) - us).cast("double") / F.lit(float(HOUR_US)), 1)
