"""Budgets, quotas and the health of live capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import minutes_between
from .measures import money

GREEN, YELLOW, AMBER, RED = range(4)
BANDS = ("green", "yellow", "amber", "red")


def budget_percent(spent: Column, amount: Column) -> Column:
    """Rounded half away from zero; 0 for amounts that are not positive."""
    return F.when(amount > 0, F.round(100.0 * spent / amount, 0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def band(percent: Column) -> Column:
    return F.when(percent <= 50, GREEN).when(percent <= 75, YELLOW).when(percent <= 90, AMBER).otherwise(RED)


def band_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), ordinal + 1)


def checked_budgets(budgets: DataFrame) -> DataFrame:
    """Amounts of enabled budgets are a dollar at least."""
    return budgets.withColumn("amount", F.when(F.col("enabled"), F.greatest("amount", F.lit(1.0))).otherwise(F.col("amount")))


def budget_status(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """The state of each enabled budget (name, start, end, amount, enabled), over requests of any source.

    Windows are [start, end) and may begin and end at any millisecond. Costs are summed by hour before
    they meet the budgets; of the two hours at most that a window cuts, its own rows are taken.
    """
    hour_ms = 3_600_000
    hour = F.floor(F.col("timestamp_ms") / hour_ms)
    sums = [F.sum("cost_usd").alias("cost"), F.count_if((F.col("event_type") == "api_request") & F.col("cost_usd").isNull()).alias("unpriced")]
    budget = ["name", "amount", "start", "end"]
    wanted = budgets.where("enabled").select(*budget).distinct()
    first, last = F.ceil(F.col("start") / hour_ms), F.floor(F.col("end") / hour_ms) - 1
    whole = wanted.where(first <= last).select(*budget, F.explode(F.sequence(first, last)).alias("hour"))
    hourly = requests.groupBy(hour.alias("hour")).agg(*sums)
    cut = lambda edge: F.when(F.col(edge) % hour_ms != 0, F.floor(F.col(edge) / hour_ms))
    cuts = wanted.select(*budget, F.explode(F.array_distinct(F.array(cut("start"), cut("end")))).alias("hour")).where("hour is not null")
    own = requests.withColumn("hour", hour).join(cuts, "hour").where((F.col("timestamp_ms") >= F.col("start")) & (F.col("timestamp_ms") < F.col("end")))
    parts = whole.join(hourly, "hour").select(*budget, "cost", "unpriced").unionByName(own.groupBy(*budget).agg(*sums))
    spent = wanted.join(parts, budget, "left").groupBy(*budget).agg(
        money(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("spent"), F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced")
    )
    percent = budget_percent(F.col("spent"), F.col("amount"))
    return spent.select("name", "amount", "spent", "unpriced", percent.alias("percent"), band_name(band(percent)).alias("band"), (F.col("spent") >= F.col("amount")).alias("exceeded"))


def worst_band(status: DataFrame) -> DataFrame:
    """The worst band of all budgets, green without any."""
    worst = status.agg(F.max(band(F.col("percent"))).alias("worst"))
    return worst.select(band_name(F.coalesce("worst", F.lit(GREEN))).alias("band"))


def quota_status(windows: DataFrame, near: float = 75.0) -> DataFrame:
    """By snapshot: the most used window, and whether any is near its limit; nulls are ignored."""
    return windows.groupBy("fetched_ms").agg(
        F.max_by("window", F.struct("utilization", "window")).alias("most_used"),
        F.max("utilization").alias("utilization"),
        F.coalesce(F.bool_or(F.col("utilization") > near), F.lit(False)).alias("near_limit"),
    )


def with_reset_times(windows: DataFrame, now_ms: Column) -> DataFrame:
    """Add ``minutes_left`` to each window's reset, null once that is past or where there is none."""
    return windows.withColumn("minutes_left", F.when(F.col("resets_at_ms") > now_ms, minutes_between(now_ms, F.col("resets_at_ms"))))


def usage_band(percent: Column) -> Column:
    """ok below 75, warning up to 90, danger above, unknown without a percentage."""
    return F.when(percent > 90, "danger").when(percent >= 75, "warning").when(percent.isNotNull(), "ok").otherwise("unknown")


def latest_snapshot(windows: DataFrame) -> DataFrame:
    """The windows of the last snapshot."""
    last = windows.agg(F.max("fetched_ms").alias("fetched_ms"))
    return windows.join(F.broadcast(last), "fetched_ms")  # one row


def silent_gaps(requests: DataFrame, minutes: int = 10) -> DataFrame:
    """Every stretch of at least ``minutes`` between two live rows that follow each other.

    Rows are cut into hours; each hour looks at its own rows, and the hours' first and last rows meet
    in a second step of a row for each hour.
    """
    live = requests.where("source = 'otel'").select("timestamp_ms", F.floor(F.col("timestamp_ms") / 3_600_000).alias("hour"))
    inner = live.withColumn("before", F.lag("timestamp_ms").over(Window.partitionBy("hour").orderBy("timestamp_ms"))).where("before is not null")
    ends = live.groupBy("hour").agg(F.min("timestamp_ms").alias("lo"), F.max("timestamp_ms").alias("hi"))
    outer = ends.select(F.col("lo").alias("timestamp_ms"), F.lag("hi").over(Window.orderBy("hour")).alias("before")).where("before is not null")
    gaps = inner.select("timestamp_ms", "before").unionByName(outer)
    return gaps.where(F.col("timestamp_ms") - F.col("before") >= minutes * 60_000).select(
        F.col("before").alias("from_ms"), F.col("timestamp_ms").alias("to_ms"), F.expr("(timestamp_ms - before) div 60000").alias("minutes")
    )
