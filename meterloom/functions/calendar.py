"""Local days, months and quiet hours in an explicit time zone.

Times are epoch milliseconds in UTC. Nothing depends on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY_MS = 86_400_000


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def utc_time(ms) -> Column:
    """The zone-less UTC time of epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", _column(ms), F.expr(EPOCH))


def local_time(ms, zone: str) -> Column:
    """The zone-less wall-clock time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time(ms))


def local_date(ms, zone: str) -> Column:
    return local_time(ms, zone).cast("date")


def midnight_ms(date: Column, zone: str) -> Column:
    """Epoch milliseconds of a date's local midnight: the earlier of two, or the first instant after a gap."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), date.cast("timestamp_ntz"))
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH), utc)


def day_window(date: Column, zone: str) -> Column:
    """(start, end): [local midnight, the next one)."""
    return F.struct(midnight_ms(date, zone).alias("start"), midnight_ms(F.date_add(date, 1), zone).alias("end"))


def month_window(date: Column, zone: str) -> Column:
    first = F.trunc(date, "MM")
    return F.struct(midnight_ms(first, zone).alias("start"), midnight_ms(F.add_months(first, 1), zone).alias("end"))


def month_key(ms, zone: str) -> Column:
    return F.date_format(local_date(ms, zone), "yyyy-MM")


def day_spine(spark: SparkSession, first: Column, last: Column, zone: str) -> DataFrame:
    """(day, start, end) for each local day from ``first`` to ``last``; no rows where either is null."""
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    window = day_window(F.col("day"), zone)
    return days.select("day", window["start"].alias("start"), window["end"].alias("end"))


def trailing_days(spark: SparkSession, last: Column, n: int, zone: str) -> DataFrame:
    """The spine of the ``n`` days up to ``last``."""
    return day_spine(spark, F.date_sub(last, n - 1), last, zone)


def clamped_days(spine: DataFrame, start: Column, end: Column) -> DataFrame:
    """The spine cut to a window [start, end): the first and last day may be partial."""
    cut = spine.select("day", F.greatest("start", start).alias("start"), F.least("end", end).alias("end"))
    return cut.where("start < end")


def minute_of_day(ms, zone: str) -> Column:
    local = local_time(ms, zone)
    return F.hour(local) * 60 + F.minute(local)


def clock_minutes(text: Column) -> Column:
    """Minutes of a 24-hour ``HH:MM``, null where malformed."""
    ok = text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(ok, F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))


def is_quiet(ms, start: Column, end: Column, zone: str) -> Column:
    """Inside the daily window [start, end), which may wrap midnight; equal or malformed ends are never quiet."""
    at, a, b = minute_of_day(ms, zone), clock_minutes(start), clock_minutes(end)
    inside = F.when(a < b, (at >= a) & (at < b)).when(a > b, (at >= a) | (at < b)).otherwise(F.lit(False))
    return F.coalesce(inside, F.lit(False))


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes, 0 at least."""
    return F.greatest(F.floor((later - earlier) / 60_000), F.lit(0))
