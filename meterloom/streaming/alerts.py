"""Alerts on a stream of requests: bursts, steps of the month, and silence, with state for each key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.calendar import is_quiet, month_key
from ..operators.alerts import BurstRule

MINUTE_MS = 60_000
ALERTS = "key string, kind string, timestamp_ms long, spend double, steps long"


@dataclass(frozen=True)
class AlertRules:
    """``step`` of 0 turns steps off; ``silence_minutes`` of 0 the silence alert; rows before ``floor_ms`` raise nothing.

    Windows are whole ticks of ``tick_ms`` and end with the tick of the row that is evaluated.
    """

    burst: BurstRule = BurstRule()
    step: float = 0.0
    silence_minutes: float = 0
    floor_ms: int = 0
    tick_ms: int = MINUTE_MS


class AlertProcessor(StatefulProcessor):
    """Rows of a key, summed by tick (a minute by default); state: sums by tick, the end of the cooldown, the month's spend and step.

    Alerts are evaluated at the last row of each tick, as the batch twins do. The sums that have
    left the window are dropped with every batch, so a key's state is as long as the window. A quiet
    crossing fires nothing and leaves the cooldown unarmed; a quiet step counts as passed. A new month
    starts without an alert.
    """

    def __init__(self, rules: AlertRules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "cost double")
        self.until = handle.getValueState("until", "until_ms long")
        self.month = handle.getValueState("month", "month string, spend double, steps long")
        self.last = handle.getValueState("last", "last_ms long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for _, row in initialState.iterrows():
            self.month.update((row["month"], float(row["spend"]), int(row["steps"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rules, fired = self.rules, []
        newest = self.last.get()[0] if self.last.exists() else 0
        parts = []
        for part in rows:  # what is kept of each part is a row for each minute
            own = part.assign(minute=part.timestamp_ms // self.rules.tick_ms, cost=part.cost_usd.fillna(0.0).astype(float)).sort_values("timestamp_ms")
            own["live"] = own.cost.where(own.timestamp_ms >= rules.floor_ms, 0.0)
            parts.append(own.groupby(["month", "minute"], as_index=False).agg(cost=("cost", "sum"), live=("live", "sum"), at=("timestamp_ms", "last"), quiet=("quiet", "last")))
        if parts:
            minutes = pd.concat(parts).sort_values("at").groupby(["month", "minute"], as_index=False).agg({"cost": "sum", "live": "sum", "at": "last", "quiet": "last"})
            minutes = minutes.sort_values("minute", ignore_index=True)
            newest = max(newest, int(minutes["at"].max()))
            fired = self._steps(key[0], minutes) + self._bursts(key[0], minutes, newest)
        self.last.update((newest,))
        if rules.silence_minutes:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(rules.silence_minutes * MINUTE_MS))
        yield pd.DataFrame(fired, columns=["key", "kind", "timestamp_ms", "spend", "steps"]).astype({"steps": "Int64"})

    def _steps(self, key, minutes: pd.DataFrame) -> list[tuple]:
        """Alerts on new highest steps of the newest month, evaluated at the end of each minute."""
        rules, fired = self.rules, []
        month, spend, steps = self.month.get() if self.month.exists() else (None, 0.0, 0)
        latest = max(minutes["month"].max(), month or "")
        if latest != month:
            month, spend, steps = latest, 0.0, 0
        own = minutes[minutes["month"] == month]
        total = spend + own["cost"].cumsum()
        if rules.step > 0 and len(own):
            passed = (total // rules.step).clip(lower=0).cummax().clip(lower=steps).astype(int)
            rises = passed > passed.shift(fill_value=steps)
            alive = rises & ~own["quiet"] & (own["at"] >= rules.floor_ms)
            fired = [(key, "step", int(at), round(float(s), 6), int(p)) for at, s, p in zip(own["at"][alive], total[alive], passed[alive], strict=True)]
            steps = int(passed.iloc[-1])
        self.month.update((month, float(total.iloc[-1]) if len(own) else spend, steps))
        return fired

    def _bursts(self, key, minutes: pd.DataFrame, newest: int) -> list[tuple]:
        """Alerts on rolling sums at the threshold, evaluated at the end of each minute that has rows, outside the cooldown."""
        rules, burst, fired = self.rules, self.rules.burst, []
        until = self.until.get()[0] if self.until.exists() else -1
        live = minutes[minutes["at"] >= rules.floor_ms].groupby("minute").agg(live=("live", "sum"), at=("at", "last"), quiet=("quiet", "last"))
        kept = pd.Series({k[0]: v[0] for k, v in self.minutes.iterator()}, dtype=float)
        sums = kept.add(live["live"], fill_value=0.0).sort_index()
        ran, places = sums.cumsum().to_numpy(), sums.index.to_numpy()
        ends = places.searchsorted(live.index.to_numpy(), "right")
        span = burst.window_minutes * MINUTE_MS // rules.tick_ms
        starts = places.searchsorted(live.index.to_numpy() - span, "right")
        rolling = [float(ran[e - 1] - (ran[b - 1] if b else 0.0)) for b, e in zip(starts, ends, strict=True)]
        for at, quiet, spend in zip(live["at"], live["quiet"], rolling, strict=True):
            if round(spend, 6) >= burst.threshold and at >= until and not quiet:
                fired.append((key, "burst", int(at), round(spend, 6), None))
                until = int(at) + burst.cooldown_minutes * MINUTE_MS
        oldest = newest // rules.tick_ms - span
        self.minutes.clear()
        for minute, cost in sums[sums.index > oldest].items():
            self.minutes.updateValue((int(minute),), (float(cost),))
        self.until.update((until,))
        return fired

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        yield pd.DataFrame([(key[0], "silence", last, None, None)], columns=["key", "kind", "timestamp_ms", "spend", "steps"]).astype({"steps": "Int64", "spend": "float64"})

    def close(self) -> None:
        pass


def stream_alerts(requests: DataFrame, rules: AlertRules, key: str = "model", zone: str = "UTC", quiet: tuple[str, str] = ("", ""), initial: DataFrame | None = None) -> DataFrame:
    """Alerts (key, kind, timestamp_ms, spend, steps) of a stream of requests with a key.

    ``initial`` (key, month, spend, steps) sets the month's steps after a backfill, so what was
    recovered raises nothing. Rows without a key are a key of their own. The state store must be RocksDB. With the silence alert there is
    always another batch to come, so run that with a trigger interval, not with ``availableNow``.
    """
    slim = requests.select(
        F.col(key).alias("key"), "timestamp_ms", "cost_usd", month_key("timestamp_ms", zone).alias("month"), is_quiet(F.col("timestamp_ms"), F.lit(quiet[0]), F.lit(quiet[1]), zone).alias("quiet")
    )
    return slim.groupBy("key").transformWithStateInPandas(
        AlertProcessor(rules),
        ALERTS,
        "append",
        "processingTime" if rules.silence_minutes else "none",
        initialState=initial.groupBy("key") if initial is not None else None,
    )


def month_baseline(requests: DataFrame, step: float, month: str, key: str = "model", zone: str = "UTC") -> DataFrame:
    """(key, month, spend, steps) of a month so far, as the initial state of ``stream_alerts``."""
    own = requests.where(month_key("timestamp_ms", zone) == month)
    spent = own.groupBy(F.col(key).alias("key")).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("spend"))
    steps = F.when((F.lit(step) > 0) & (F.col("spend") > 0), F.floor(F.col("spend") / F.lit(step or 1.0))).otherwise(0).cast("long")
    return spent.select("key", F.lit(month).alias("month"), "spend", steps.alias("steps"))
