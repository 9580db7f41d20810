"""Windows to the millisecond, alerts by tick, matches of one row each, and sessions added up over days, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterloom.operators import alerts, partials, reconcile, rollups

from .test_domain import finished
from .test_stored import DAY, KIND, T, request

MINUTE = 60_000


def test_spend_before(spark):
    """Rows at now and at the start, instants without rows, cells without rows between, a null key, and a key with a third of all rows."""
    rng = random.Random(3)
    rows = [(*request(i, T + rng.randrange(7_000_000)), rng.choice(["hot", "hot", "a", "b", None])) for i in range(900)]
    rows += [(*request(900 + i, T + 1_000_000), "hot") for i in range(450)] + [(*request(2000, T + 2_000_000, cost=None), "a")]
    frame = spark.createDataFrame(rows, f"{KIND}, k string")
    places = [(k, T + ms) for k in ("hot", "a", None, "none") for ms in (0, 1_000_000, 1_000_001, 1_600_000, 1_600_001, 50_000_000, *(rng.randrange(8_000_000) for _ in range(40)))] + [("b", rows[5][2])] * 2
    got = alerts.spend_before(frame, spark.createDataFrame(places, "k string, now_ms long"), 600_000, "k")
    want = {(k, now, float(sum(r[5] or 0 for r in rows if r[-1] == k and now - 600_000 <= r[2] < now))) for k, now in places}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_key_is_dealt_out(spark):
    """The rows of one key alone, over some cells, are in several tasks; none has them all."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.lit("hot").alias("model"), (F.lit(T) + F.col("id") * 500).alias("timestamp_ms"), F.lit(1.0).alias("cost_usd"))
        found = alerts.spend_before(rows, rows.select("model", F.col("timestamp_ms").alias("now_ms")), 60_000)
        assert found.where("spend = 120").count() == 20_000 - 120
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and max(r["count"] for r in tasks) < 15_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("tick", [1000, 5000, MINUTE])
def test_bursts_by_tick(spark, tmp_path, tick):
    """Batch and stream against a loop over ticks; windows end with the tick of the row."""
    rng = random.Random(tick)
    rows = [request(i, T + rng.randrange(3_600_000), cost=float(rng.randrange(1, 4))) for i in range(400)]
    frame, rule = spark.createDataFrame(rows, KIND), alerts.BurstRule(14.0, 2, 3)
    fired, until = [], 0
    for now in sorted({(r[2] // tick + 1) * tick for r in rows}):
        spend = sum(r[5] for r in rows if now - 120_000 <= r[2] < now)
        if spend >= 14 and now >= until:
            fired.append((now, spend))
            until = now + 180_000
    assert sorted((r["now_ms"], r["spend"]) for r in alerts.bursts(frame, rule, tick_ms=tick).collect()) == fired and len(fired) > 3
    from meterloom.streaming.alerts import AlertRules, stream_alerts

    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = finished(stream_alerts(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), AlertRules(rule, tick_ms=tick)), tmp_path, f"bursts{tick}")
    want, until = [], -1
    for mark in sorted({r[2] // tick for r in rows}):  # at the tick's last row, whose time starts the cooldown
        at = max(r[2] for r in rows if r[2] // tick == mark)
        spend = sum(r[5] for r in rows if (mark + 1) * tick - 120_000 <= r[2] < (mark + 1) * tick)
        if spend >= 14 and at >= until:
            want.append((at, spend))
            until = at + 180_000
    assert sorted((r["timestamp_ms"], r["spend"]) for r in got if r["kind"] == "burst") == want


def test_alerts_of_the_null_key(spark, tmp_path):
    from meterloom.streaming.alerts import AlertRules, month_baseline, stream_alerts

    rows = spark.createDataFrame([request(i, T + i * MINUTE, cost=6.0) for i in range(20)], KIND).withColumn("model", F.lit(None).cast("string"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = finished(stream_alerts(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), AlertRules(alerts.BurstRule(10.0, 10, 15))), tmp_path, "nulls")
    assert Counter((r["key"], r["kind"]) for r in got) == {(None, "burst"): 2}
    assert [tuple(r) for r in month_baseline(rows, 50.0, "2026-01").collect()] == [(None, "2026-01", 120.0, 2)]


def plain_matches(left, right, within):
    """The nearest pair next, of equal distances the earliest; counts of (key, left time, right time)."""
    out, left, right = Counter(), list(left), list(right)
    while True:
        pairs = [(abs(a[1] - b[1]), min(a[1], b[1]), i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a[0] == b[0] is not None and abs(a[1] - b[1]) <= within]
        if not pairs:
            return out
        _, _, i, j = min(pairs)
        out[left[i][0], left[i][1], right[j][1]] += 1
        del left[i], right[j]


@pytest.mark.parametrize("seed", range(4))
def test_nearest_matches(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(rng.choice(["a", "b", None]), T + rng.randrange(400 if seed % 2 else 60)) for _ in range(n)]
    left, right = draw(60) + [("same", T)] * 30, draw(50) + [("same", T + 7)] * 40 + [("same", T - 7)] * 3
    frame = lambda rows: spark.createDataFrame([(f"{i:03d}", ms, k, 1) for i, (k, ms) in enumerate(rows)], "id string, timestamp_ms long, k string, n int")
    got = reconcile.nearest_matches(frame(left), frame(right), 9, ("k", "n")).collect()
    assert len({r["left_id"] for r in got}) == len({r["right_id"] for r in got}) == len(got)
    found = Counter((left[int(r["left_id"])][0], left[int(r["left_id"])][1], right[int(r["right_id"])][1]) for r in got)
    assert all(left[int(r["left_id"])][0] == right[int(r["right_id"])][0] for r in got)
    assert found == plain_matches(left, right, 9)
    assert reconcile.nearest_matches(frame(left).where("false"), frame(right), 9, ("k", "n")).count() == 0


def test_equal_rows_match_once(spark):
    """A thousand equal rows on both sides: a thousand matches in one round."""
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(T).alias("timestamp_ms"), F.lit("s").alias("k"))
    got = reconcile.nearest_matches(rows, rows, 2000, ("k",))
    assert got.count() == got.select("left_id").distinct().count() == got.select("right_id").distinct().count() == 1000


def test_matches_read_their_sides_once(spark, tmp_path):
    """Both sides are written as they come; what is found is put together from that and not from them."""
    spark.range(40).select(F.col("id").cast("string").alias("id"), (T + F.col("id") * 5).alias("timestamp_ms"), F.lit("s").alias("k")).write.parquet(str(tmp_path / "given"))
    rows = spark.read.parquet(str(tmp_path / "given"))
    got = reconcile.nearest_matches(rows, rows, 2000, ("k",))
    assert got.count() == 40 and got.inputFiles() and not any("/given/" in f for f in got.inputFiles())


def test_partials_add_up(spark):
    """Any days and facets from partials, sessions over midnights once; numbers that are known stay; more than one bucket of numbers."""
    rows = [request(i, T + (i * 7_919_000) % (4 * DAY), session=None if i % 13 == 0 else f"s{i % 400}", cost=None if i % 9 == 0 else i / 4) for i in range(1200)]
    frame = spark.createDataFrame(rows, KIND).withColumn("query_source", F.when(F.col("timestamp_ms") % 3 == 0, "subagent")).withColumn("model", F.when(F.col("timestamp_ms") % 5 > 0, "m"))
    early, late = frame.where(f"timestamp_ms < {T + 2 * DAY}"), frame.where(f"timestamp_ms >= {T + 2 * DAY}")
    first = partials.number_sessions(early).checkpoint()
    numbers = partials.number_sessions(frame, first).checkpoint()
    assert sorted(r["number"] for r in numbers.collect()) == list(range(400)) and first.exceptAll(numbers).isEmpty()
    spread = numbers.withColumn("number", F.col("number") * 200)  # buckets of 32,768
    daily = partials.daily_partials(early, spread).unionByName(partials.daily_partials(late, spread)).checkpoint()
    days = F.col("day") >= F.date_add(F.lit("1970-01-01").cast("date"), T // DAY + 1)
    for facet, plain in ((F.lit(True), F.lit(True)), (days & ~F.col("main"), (F.col("timestamp_ms") >= (T // DAY + 1) * DAY) & (F.col("query_source") == "subagent")), (F.col("model") == "m", F.col("model") == "m"), (F.lit(False), F.lit(False))):
        got, want = partials.summary_of_partials(daily.where(facet)).first().asDict(), rollups.usage_summary(frame.where(plain)).first().asDict()
        assert got == want
