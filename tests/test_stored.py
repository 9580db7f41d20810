"""Stored tables and lossless streams: restarts, late rows, pruning, against the batch operators over everything."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterloom.operators import reconcile, rollups
from meterloom.operators.facets import Facets, apply_facets
from meterloom.plans import testbed
from meterloom.sources import tables, telemetry
from meterloom.streaming import requests as live

from .test_domain import body, finished, record

DAY = 86_400_000
T = 1_768_435_200_000


def request(i, ms, source="otel", ident="r", session="s", cost=1.0, five=None):
    return (None if i is None else f"{ident}{i}", session, ms, "m", None, cost, 1, 2, 3, 4, five, None, "api_request", None, None, source)


KIND = "request_id string, session_id string, timestamp_ms long, model string, query_source string, cost_usd double, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cache_creation_5m_tokens long, cache_creation_1h_tokens long, event_type string, error string, duration_ms long, source string"


def rows_of(frame):
    names = sorted(c for c in frame.columns if c != "arrival")
    return Counter(tuple(r[c] for c in names) for r in frame.collect())


def batches(seed, n):
    """Batches of both sources: ids repeated within and over batches and sources, on other days too, and rows without an id."""
    rng, out = random.Random(seed), []
    for b in range(n):
        source = rng.choice(["otel", "backfill"])
        out.append((source, [(*request(rng.choice([None, *range(30)]), T + rng.randrange(4) * DAY + rng.randrange(1000), source, cost=rng.randrange(9) / 2, five=rng.choice([None, 3])), b * 100 + k) for k in range(rng.randrange(1, 12))]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_store_equals_all_batches(spark, tmp_path, seed, monkeypatch):
    """Failures before the manifest and between the two tables, batches that come twice, and readers of the last manifest."""
    every, done = batches(seed, 9), []
    frame = lambda rows: spark.createDataFrame(rows, f"{KIND}, arrival long").coalesce(2)
    paths = str(tmp_path / "requests"), str(tmp_path / "days")
    for b, (source, rows) in enumerate(every):
        if b % 3 == 1:
            where = tables.Parts if b % 2 else tables.RequestStore
            name = "commit" if b % 2 else "upsert"
            with monkeypatch.context() as m:
                m.setattr(where, name, lambda *a, **k: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    tables.apply_arrivals(tables.RequestStore(spark, paths[0], 3), tables.DayTable(spark, paths[1]), frame(rows), source, b)
            if b % 2:
                assert rows_of(tables.RequestStore(spark, paths[0], 3).requests()) == rows_of(reconcile.reconcile_requests(frame(done)))
        before = tables.RequestStore(spark, paths[0], 3).requests() if done else None
        for _ in range(2):
            tables.apply_arrivals(tables.RequestStore(spark, paths[0], 3), tables.DayTable(spark, paths[1]), frame(rows), source, b)
        if before is not None:
            assert rows_of(before) == rows_of(reconcile.reconcile_requests(frame(done)))
        done += rows
    want = rows_of(reconcile.reconcile_requests(frame(done)))
    store, days = tables.RequestStore(spark, paths[0], 3), tables.DayTable(spark, paths[1])
    assert rows_of(store.requests()) == want and rows_of(days.read()) == want
    assert max(len(r) for r in store.parts.manifest["parts"].values()) < 6
    facets = Facets(start=T + DAY + 5, end=T + 3 * DAY)
    assert rows_of(days.read(facets)) == rows_of(reconcile.reconcile_requests(frame(done)).where(f"timestamp_ms >= {facets.start} and timestamp_ms < {facets.end}"))


def test_what_is_written_follows_the_batch(spark, tmp_path):
    """A small batch after a large one writes small runs; rows are written again a logarithmic number of times."""
    store = tables.RequestStore(spark, str(tmp_path / "r"), 4)
    arrivals = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("otel").alias("source"), F.col("id").alias("timestamp_ms"), F.col("id").alias("arrival"))
    store.upsert(arrivals(0, 4000), "otel", 0)
    written = 0
    for b in range(1, 17):
        version = store.parts.manifest["version"]
        store.upsert(arrivals(4000 + 40 * b, 4040 + 40 * b), "otel", b)
        written += sum(n for runs in store.parts.manifest["parts"].values() for v, n in runs if v > version)
    assert written < 16 * 40 * 6 and store.requests().count() == 4640
    assert all(runs[0][0] == 1 for runs in store.parts.manifest["parts"].values())  # the large run was left alone
    left = {p.name for p in (tmp_path / "r" / "_manifests").iterdir() if p.suffix == ".json"}
    assert len(left) == tables.KEPT_VERSIONS + 1


def test_batches_read_their_own_rows(spark, sf, monkeypatch):
    """The query's batches go into the store from what was delivered, of which each reads its own folders alone; none reads the events."""
    from meterloom.plans.catalog import QUERIES

    read, upsert = [], tables.RequestStore.upsert

    def noted(store, batch, *of):
        read.append(batch._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters: [")[2].partition("]")[0])
        assert not any("events" in f for f in batch.inputFiles())
        return upsert(store, batch, *of)

    monkeypatch.setattr(tables.RequestStore, "upsert", noted)
    assert QUERIES["stored_requests"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(set(read)) == 6 and all("(from#" in x and "(i#" in x for x in read)


def test_days_are_pruned(spark, sf, tmp_path):
    """A week reads its folders alone, and facets over it give what they give over everything."""
    requests, sessions = testbed.requests(spark, sf), testbed.sessions(spark, sf)
    days = tables.DayTable(spark, str(tmp_path / "d"))
    assert days.replace(requests) and not days.replace(requests)
    facets = Facets.preset("week", testbed.NOW_MS - DAY, model="m-view", source="main")
    found = days.read(facets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert len({f.rpartition("/day=")[2].partition("/")[0] for f in found.inputFiles()}) == 7
    want = rollups.usage_summary(apply_facets(requests, sessions, facets)).collect()
    assert rollups.usage_summary(apply_facets(found, sessions, facets)).collect() == want
    one = requests.where(F.col("request_id") == "req_5").withColumn("cost_usd", F.lit(7.5))
    before = days.read().where("request_id = 'req_5'")
    day = str(before.select(tables.day_of(F.col("timestamp_ms"))).first()[0])
    kept = {k: v for k, v in days.parts.manifest["parts"].items() if k != day}
    days.apply(before, one, "mend", 0)
    assert rows_of(days.read()) == rows_of(requests.where("request_id != 'req_5'").unionByName(one))
    assert {k: v for k, v in days.parts.manifest["parts"].items() if k != day} == kept
    assert days.parts.manifest["parts"][day] != kept.get(day)


def test_late_requests_are_kept(spark, tmp_path):
    """One request a batch, some two hours or three days older than those before; a redelivery goes."""
    ages = [0, 1, 2, 3, 7200, 4, 260_000]
    bodies = [body([record(request_id=f"q{i}", cost_usd=1.0, nano=str((T + 1_000_000_000 - age * 1000) * 1_000_000))]) for i, age in enumerate(ages)]
    bodies.append(bodies[4])
    (tmp_path / "in").mkdir()
    stream = live.stream_requests(telemetry.read_otlp_logs(spark, str(tmp_path / "in"), streaming=True))
    for i, text in enumerate(bodies):
        (tmp_path / "in" / f"{i}.json").write_text(text + "\n")
        live.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "otel").awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["request_id"] for r in stored.collect()) == [f"q{i}" for i in range(7)]


def test_stream_into_the_store(spark, tmp_path):
    """Requests of a stream in the store and by day, and the totals of a day without the others."""
    rows = [request(i % 50, T + i * 2_000_000, session=f"s{i % 7}") for i in range(90)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "tables")
    for _ in range(2):
        live.store_stream(stream, folder, str(tmp_path / "cp")).awaitTermination(120)
    store = tables.RequestStore(spark, f"{folder}/requests")
    got = store.requests()
    assert got.count() == 50 and rows_of(tables.DayTable(spark, f"{folder}/days").read()) == rows_of(got)
    want = rollups.usage_summary(got.where(f"timestamp_ms >= {T + DAY} and timestamp_ms < {T + 2 * DAY}")).collect()
    assert live.today_stored(spark, folder, T + DAY, T + 2 * DAY).collect() == want


def test_sessions_of_a_stream(spark, tmp_path):
    """Distinct sessions of each day are exact: rows days late, sessions over midnight and over batches, many of them."""
    rows = [request(i, T + (i % 5) * DAY + i, session=None if i % 11 == 0 else f"s{i % 700}") for i in range(3000)]
    table = spark.createDataFrame(rows, KIND)
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for keep in (None, "40 days"):
        got = {str(r["day"]): (r["sessions"], r["requests"], r["cost_usd"]) for r in finished(live.stream_today(stream, keep=keep), tmp_path, f"day{bool(keep)}", "complete")}
        want = table.groupBy(tables.day_of(F.col("timestamp_ms")).alias("day")).agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("n"), F.sum("cost_usd").alias("c"))
        assert got == {str(r["day"]): (r["sessions"], r["n"], r["c"]) for r in want.collect()}


def test_actions_of_rows_without_an_id(spark):
    """All are inserted, and no window holds them."""
    rows = [(*request(None, T + i), i) for i in range(20)] + [(*request(1, T, s), 30 + k) for k, s in enumerate(("backfill", "otel", "otel"))]
    actions = reconcile.reconcile_actions(spark.createDataFrame(rows, f"{KIND}, arrival long"))
    assert Counter(r["action"] for r in actions.collect()) == {"inserted": 21, "took over": 1, "unchanged": 1}
    window = actions._jdf.queryExecution().optimizedPlan().toString().partition("Window")[2]
    assert "isnotnull(request_id" in window


def test_health_of_a_stream(spark, tmp_path):
    """Counters and the last failure of a live stream are those of the batch query; bad bodies are set aside; a rerun counts nothing."""
    import time

    from meterloom.streaming.health import IngestHealth, ingest_stream

    good = [body([record(request_id=f"a{i}", cost_usd=1.0, nano=str((T + i) * 1_000_000)), record("user_prompt"), record(request_id=f"f{i}", session=None, nano=str((T + 50 - i) * 1_000_000))]) for i in range(5)]
    texts = [*good, "no JSON", "{}", "[1", body([record("api_error", nano=str((T + 99) * 1_000_000), error="x")])]
    (tmp_path / "in").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.json").write_text(text + "\n")
    health = IngestHealth()
    spark.streams.addListener(health)
    try:
        bodies = spark.readStream.format("text").option("maxFilesPerTrigger", 4).load(str(tmp_path / "in")).withColumnRenamed("value", "body")
        for _ in range(2):
            ingest_stream(bodies, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
        until = time.time() + 30
        while health.snapshot()["ingested"] < 6 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(health)
    batch = spark.createDataFrame([(t,) for t in texts], "body string")
    events = telemetry.parse_otlp_events(telemetry.log_records(batch))
    want, last = telemetry.ingest_metrics(events).first().asDict(), telemetry.last_failure(events).first()
    got = health.snapshot()
    assert got == {**want, "rejected": 2, "failed_ms": last["timestamp_ms"], "last_failure": last["failure"]}
    assert want == {"ingested": 6, "failed": 5, "skipped": 5, "newest_ms": T + 99}
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert Counter(r["status"] for r in bad.collect()) == {"rejected": 2, "failed": 5}
    assert {r["body"] for r in bad.where("status = 'rejected'").collect()} == {"no JSON", "[1"}
    assert all(r["failure"].endswith(": no session") for r in bad.where("status = 'failed'").collect())
    assert live.stored_requests(spark, str(tmp_path / "out")).count() == 6
    again = IngestHealth(got)
    assert again.snapshot() == got


def test_transcripts_are_collapsed_as_they_come(spark, tmp_path):
    """Requests whose lines are split over batches and files, and messages, against the batch operators over all lines."""
    import json

    from meterloom.operators import transcripts
    from meterloom.sources.tail import Tail

    rng, root = random.Random(5), tmp_path / "in"
    root.mkdir()
    usage = lambda n: {"input_tokens": n, "output_tokens": n}
    store, every = tables.TranscriptStore(spark, str(tmp_path / "store"), 3), 0
    for batch in range(5):
        for k in range(12):
            kind = rng.choice(["assistant", "assistant", "user"])
            line = {"type": kind, "uuid": f"u{every}", "sessionId": "s", "timestamp": "2026-01-15T00:00:01.500Z", "message": {"model": "m", "content": [{"type": "text"}]}}
            if kind == "assistant":
                line |= {"requestId": rng.choice([f"r{rng.randrange(6)}", None])}
                line["message"]["usage"] = usage(rng.choice([0, rng.randrange(50)]))
            with open(root / f"f{k % 2}.jsonl", "a") as f:
                f.write(json.dumps(line) + "\n")
            every += 1
        tail = Tail(spark, str(root), str(tmp_path / "tail"))
        assert tail.step()
        for _ in range(2):
            tables.TranscriptStore(spark, str(tmp_path / "store"), 3).add(tail.lines(batch), "t", batch)
    tail, store = Tail(spark, str(root), str(tmp_path / "tail")), tables.TranscriptStore(spark, str(tmp_path / "store"), 3)
    parsed = transcripts.parse_lines(tail.lines().drop("batch"))
    assert parsed.count() == every
    assert rows_of(store.requests()) == rows_of(transcripts.transcript_requests(transcripts.collapse_requests(transcripts.extract_usage(parsed))))
    assert rows_of(store.messages()) == rows_of(transcripts.collapse_messages(transcripts.extract_messages(parsed)))
