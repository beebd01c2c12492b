"""Decimal days since 1900-01-01 (datenum) and the period keys of output files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 1900-01-01 to 1970-01-01.
EPOCH = 25567
DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def datenum(ts: Column) -> Column:
    """Decimal days since 1900-01-01; earlier times raise."""
    days = micros(ts) / F.lit(float(DAY_US)) + EPOCH
    return F.when(days >= 0, days).when(days.isNotNull(), F.raise_error(F.lit("date before 1900")).cast("double"))


def from_datenum(days: Column) -> Column:
    """Timestamp of decimal days, to the nearest millisecond (halves go up)."""
    return F.timestamp_millis(F.floor((days - EPOCH) * 86_400_000 + 0.5).cast("long"))


def parse_date(days: Column) -> Column:
    return F.date_add(F.lit("1900-01-01").cast("date"), F.floor(days).cast("int"))


def parse_time_ms(days: Column) -> Column:
    """Milliseconds of the day, halves up; the last half millisecond belongs to the next day."""
    return (F.floor(days * 86_400_000 + 0.5) - F.floor(days) * 86_400_000).cast("long")


def to_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def from_text(s: Column) -> Column:
    """``yyyy-MM-dd`` with or without ``HH:mm:ss``; anything else is null."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def filename_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def time_spent(seconds: Column) -> Column:
    """Elapsed seconds as hours, minutes and seconds."""
    s = seconds.cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def iso_week(ts: Column) -> Column:
    return F.format_string("%04dw%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def period_key(ts: Column, kind: str) -> Column:
    """Suffix of the output file that a time belongs to."""
    if kind == "daily":
        return F.format_string("%04dd%03d", F.year(ts), F.dayofyear(ts))
    if kind == "weekly":
        return iso_week(ts)
    if kind in ("monthly", "yearly"):
        return F.date_format(ts, "yyyy'm'MM" if kind == "monthly" else "yyyy")
    raise ValueError(f"no such period: {kind}")


def shift_date(day: Column, frequency: str, jump: int) -> Column:
    """The file date one period away: a day, the first of a month, or the first of a year."""
    if frequency == "daily":
        return F.date_add(day, jump)
    if frequency == "monthly":
        return F.add_months(F.trunc(day, "month"), jump)
    if frequency == "yearly":
        return F.add_months(F.trunc(day, "year"), 12 * jump)
    raise ValueError(f"files of frequency {frequency} have no neighbours")
