"""Spend alerts over stored requests: rolling sums, bursts with a cooldown, and steps of the month.

Each has a twin in ``streaming.alerts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import is_quiet, local_date, month_key
from .measures import money

MINUTE_MS = 60_000
DEFAULT_STEP = 50.0


@dataclass(frozen=True)
class BurstRule:
    """``checked`` puts these defaults where a value is not positive."""

    threshold: float = 10.0
    window_minutes: int = 10
    cooldown_minutes: int = 15

    @classmethod
    def checked(cls, threshold: float, window_minutes: int, cooldown_minutes: int) -> BurstRule:
        return cls(*[v if v > 0 else d for v, d in zip((threshold, window_minutes, cooldown_minutes), (10.0, 10, 15), strict=True)])


def checked_step(step: float) -> float:
    """The step of the month's spend, DEFAULT_STEP where it is not positive."""
    return step if step > 0 else DEFAULT_STEP


def spend_before(requests: DataFrame, instants: DataFrame, window_ms: int, key: str = "model", cell_ms: int = MINUTE_MS) -> DataFrame:
    """(key, now_ms, spend) for each distinct row of ``instants`` (key, now_ms): the known costs in [now - window, now), to the millisecond.

    A row at ``now`` itself is left out. A sum is the difference of two running sums, which are taken over
    cells of ``cell_ms`` and, in the cells that the ends of the window cut, over their rows: no row meets the
    rows of its window. A key with many rows is dealt out by cells, and within a cell has a row for each
    millisecond at most. Costs are added in whole billionths of a dollar, so that differences are exact.
    The null key is a key; an instant without rows before it has a spend of 0.
    """
    nano = F.round(F.col("cost_usd") * 1_000_000_000).cast("bigint")
    rows = requests.where("cost_usd is not null").groupBy(F.col(key).alias("key"), F.col("timestamp_ms").alias("at")).agg(F.sum(nano).alias("nano"))
    edges = F.array(F.struct(F.col("now_ms").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("now_ms") - window_ms).alias("at"), F.lit(-1).alias("sign")))
    points = instants.select(F.col(key).alias("key"), "now_ms").distinct().select("key", "now_ms", F.inline(edges))
    every = rows.select("key", "at", "nano", F.lit(None).cast("bigint").alias("now_ms"), F.lit(0).alias("sign")).unionByName(points.select("key", "at", F.lit(0).cast("bigint").alias("nano"), "now_ms", "sign"))
    every = every.withColumn("cell", F.floor(F.col("at") / cell_ms))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cells = every.groupBy("key", "cell").agg(F.sum("nano").alias("nano")).select("key", "cell", F.coalesce(F.sum("nano").over(earlier("key", "cell")), F.lit(0)).alias("before"))
    # Points have their place before the rows of their millisecond.
    inside = F.coalesce(F.sum("nano").over(earlier("key", "cell", F.struct("at", F.col("now_ms").isNull()))), F.lit(0))
    cut = every.withColumn("inside", inside).where("now_ms is not null").alias("p")
    found = cut.join(cells.alias("c"), F.col("p.key").eqNullSafe(F.col("c.key")) & (F.col("p.cell") == F.col("c.cell")))
    spend = F.sum(F.col("sign") * (F.col("before") + F.col("inside"))) / 1_000_000_000
    return found.groupBy(F.col("p.key").alias(key), "now_ms").agg(money(spend).alias("spend"))


def spend_by_tick(requests: DataFrame, window_ms: int, tick_ms: int, key: str = "model") -> DataFrame:
    """(key, now_ms, spend) at the end of each tick with known costs: those in [now - window, now), the window being whole ticks.

    Rows are summed by tick first, so a window has a row for each key and tick at most.
    """
    if window_ms % tick_ms:
        raise ValueError("the window must be a multiple of the tick; see spend_before")
    tick = F.floor(F.col("timestamp_ms") / tick_ms).cast("bigint")
    by_tick = requests.where("cost_usd is not null").groupBy(key, tick.alias("tick")).agg(F.sum("cost_usd").alias("cost"))
    order = Window.partitionBy(key).orderBy("tick").rangeBetween(1 - window_ms // tick_ms, 0)
    return by_tick.select(key, ((F.col("tick") + 1) * tick_ms).alias("now_ms"), money(F.sum("cost").over(order)).alias("spend"))


def _minute() -> Column:
    """The minute that ends at ``now_ms``."""
    return F.expr(f"now_ms div {MINUTE_MS} - 1").alias("minute")


def rolling_spend(requests: DataFrame, minutes: int, key: str = "model") -> DataFrame:
    """Spend by key of the ``minutes`` before the end of each minute with spend: [minute + 1 - minutes, minute + 1)."""
    return spend_by_tick(requests, minutes * MINUTE_MS, MINUTE_MS, key).select(key, _minute(), "spend")


def bursts(requests: DataFrame, rule: BurstRule = BurstRule(), key: str = "model", quiet: tuple[str, str] = ("", ""), zone: str = "UTC", tick_ms: int = MINUTE_MS) -> DataFrame:
    """(key, now_ms, spend) of the alerts: spend in [now - window, now) at the threshold, outside the cooldown and quiet hours.

    Evaluated at the end of each tick that has rows. Quiet crossings fire nothing and leave the cooldown
    as it is. The cooldown chains from alert to alert, but not over a stretch as long as itself without a
    crossing: stretches between those are folded each in order, so one row holds the ticks of one stretch.
    """
    order, cooldown = Window.partitionBy(key).orderBy("now_ms"), rule.cooldown_minutes * MINUTE_MS
    apart = F.coalesce(F.col("now_ms") - F.lag("now_ms").over(order) >= cooldown, F.lit(True))
    crossed = (
        spend_by_tick(requests, rule.window_minutes * MINUTE_MS, tick_ms, key)
        .where(F.col("spend") >= rule.threshold)
        .withColumn("quiet", is_quiet(F.col("now_ms") - tick_ms, F.lit(quiet[0]), F.lit(quiet[1]), zone))
        .where("not quiet")
        .withColumn("apart", apart)
        .withColumn("stretch", F.count_if("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "stretch")
        .agg(F.array_sort(F.collect_list(F.struct("now_ms", "spend"))).alias("crossings"))  # ticks of a stretch, not rows
    )
    fired = F.aggregate(
        "crossings",
        F.struct(F.lit(-1).cast("bigint").alias("until"), F.array().cast("array<struct<now_ms:bigint,spend:double>>").alias("alerts")),
        lambda s, c: F.when(
            c["now_ms"] >= s["until"],
            F.struct((c["now_ms"] + cooldown).alias("until"), F.concat(s["alerts"], F.array(c)).alias("alerts")),
        ).otherwise(s),
    )
    return crossed.select(key, F.explode(fired["alerts"]).alias("a")).select(key, "a.now_ms", "a.spend")


def burst_alerts(requests: DataFrame, rule: BurstRule = BurstRule(), key: str = "model", quiet: tuple[str, str] = ("", ""), zone: str = "UTC") -> DataFrame:
    """(key, minute, spend) of ``bursts`` that are evaluated by minute."""
    return bursts(requests, rule, key, quiet, zone).select(key, _minute(), "spend")


def milestone_alerts(requests: DataFrame, step: float, cell_ms: int = 5000, zone: str = "UTC", quiet: tuple[str, str] = ("", "")) -> DataFrame:
    """(timestamp_ms, steps, spend): one alert for each evaluation that finds a new highest step of the month.

    Rows of one cell of ``cell_ms`` are evaluated together, at the last of them. Quiet evaluations
    advance the step without an alert. Running sums are taken within days on top of the days before.
    """
    day = local_date("timestamp_ms", zone)
    cells = (
        requests.groupBy(day.alias("day"), F.expr(f"timestamp_ms div {cell_ms}").alias("cell"))
        .agg(F.sum("cost_usd").alias("cost"), F.max("timestamp_ms").alias("timestamp_ms"))
        .withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    )
    days = cells.groupBy("day").agg(F.sum("cost").alias("day_cost"))
    month = Window.partitionBy(F.trunc("day", "MM")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("day_cost").over(month), F.lit(0.0)).alias("carried"))
    order = Window.partitionBy("day").orderBy("cell")
    running = (
        cells.join(before, "day")
        .withColumn("spend", money(F.col("carried") + F.sum("cost").over(order)))
        .withColumn("carried", money(F.col("carried")))
        .withColumn("steps", F.floor(F.col("spend") / step))
        .withColumn("was", F.coalesce(F.lag("steps").over(order), F.floor(F.col("carried") / step)))
    )
    alive = running.where("steps > was").withColumn("quiet", is_quiet(F.col("timestamp_ms"), F.lit(quiet[0]), F.lit(quiet[1]), zone))
    return alive.where("not quiet").select("timestamp_ms", F.col("steps").cast("bigint").alias("steps"), "spend", month_key("timestamp_ms", zone).alias("month"))


def above_floor(requests: DataFrame, now_ms: int, window_ms: int, started_ms: int) -> DataFrame:
    """Rows that may raise live alerts: not older than the window nor than the start of watching."""
    return requests.where(F.col("timestamp_ms") >= max(now_ms - window_ms, started_ms))
