"""Prices, calendars, parsing, merging, conversations, budgets and streams against hand-made cases."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from meterloom.functions import calendar, parsing
from meterloom.operators import alerts, budgets, pricing, reconcile, transcripts
from meterloom.sources import exports, seed, telemetry
from meterloom.sources.transcripts import read_transcripts, tail_transcripts
from tests.test_rollups import SCHEMA, T, row


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_local_midnights(spark):
    at = lambda day, zone: value(spark, calendar.midnight_ms(F.lit(date.fromisoformat(day)), zone))
    assert at("2026-01-05", "UTC") == T
    assert at("2018-11-04", "America/Sao_Paulo") == 1541300400000  # midnight is skipped: 01:00
    assert at("2024-11-03", "America/Havana") == 1730606400000  # midnight comes twice: the earlier
    window = value(spark, calendar.day_window(F.lit(date(2024, 3, 31)), "Europe/Berlin"))
    assert window["end"] - window["start"] == 23 * 3_600_000
    month = value(spark, calendar.month_window(F.lit(date(2025, 12, 15)), "UTC"))
    assert (month["end"] - month["start"]) // 86_400_000 == 31


def test_quiet_hours(spark):
    ms = F.lit(T + 23 * 3_600_000)
    quiet = lambda a, b: value(spark, calendar.is_quiet(ms, F.lit(a), F.lit(b), "UTC"))
    assert quiet("22:00", "07:00") and not quiet("07:00", "22:00")
    assert not quiet("23:00", "23:00") and not quiet("25:00", "07:00") and not quiet("", "")


@pytest.mark.parametrize(
    ("text", "ms"),
    [("2026-03-02T08:15:27.944Z", 1772439327944), ("2026-03-02T08:15:27Z", 1772439327000), ("2026-03-02T08:15:27.9449Z", 1772439327944), ("2026-03-02T08:15:27.9Z", 1772439327900), ("2026-02-30T00:00:00Z", None), ("2026-03-02T08:15:27+00:00", None), ("", None)],
)
def test_times(spark, text, ms):
    assert value(spark, parsing.rfc3339_ms(F.lit(text))) == ms


def test_names(spark):
    assert value(spark, parsing.project_name(F.lit("/a/b/"))) == "b"
    assert value(spark, parsing.project_name(F.lit(None).cast("string"))) == "(unknown project)"
    assert value(spark, parsing.below_home(F.lit("/home/x"), "/home/x")) == "~"
    assert value(spark, parsing.below_home(F.lit("/home/xy"), "/home/x")) == "/home/xy"
    assert value(spark, parsing.below_home(F.lit("/home/x/y"), "/home/x")) == "~/y"


def prices(spark):
    entries = {
        "m-a": {"input_cost_per_token": 1e-5, "output_cost_per_token": 5e-5, "cache_read_input_token_cost": 1e-6, "cache_creation_input_token_cost_above_1hr": 2e-5},
        "m-b-20240101": {"input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6},
        "m-b-20250101": {"input_cost_per_token": 2e-6, "output_cost_per_token": 1e-6},
        "m-c": {"input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6, "litellm_provider": "other"},
        "m-d": {"input_cost_per_token": -1, "output_cost_per_token": 1e-6},
        "x": {"input_cost_per_token": 1e-6, "output_cost_per_token": 1e-6},
        "_meta": {"note": "none"},
    }
    return telemetry.parse_price_list(spark.createDataFrame([(json.dumps(entries),)], "text string"), "m-", "acme")


def test_price_list_and_lookup(spark):
    table = prices(spark)
    assert sorted(r["model"] for r in table.collect()) == ["m-a", "m-b-20240101", "m-b-20250101"]
    b = table.where("model = 'm-b-20250101'").first()
    assert (b["cache_read_rate"], b["cache_5m_rate"], b["cache_1h_rate"]) == pytest.approx((2e-7, 2.5e-6, 4e-6))
    names = spark.createDataFrame([("p/m-a",), (" m-a ",), ("m-a-20260101",), ("m-b",), ("",), ("zzz",), (None,)], "model string")
    got = {r["model"]: r["input_rate"] for r in pricing.resolve_prices(names, table).collect()}
    assert got == {"p/m-a": 1e-5, " m-a ": 1e-5, "m-a-20260101": 1e-5, "m-b": 2e-6, "": None, "zzz": None, None: None}


@pytest.mark.parametrize(
    ("tokens", "split"),
    [((1200, 340, 56_000, 7800), (800, 7000)), ((0, 1, 0, 0), (None, None)), ((10, 0, 5, 900), (900, 0)), ((10, 20, 30, 400), (None, None)), ((10, 20, 30, 400), (100, None))],
)
def test_costs(spark, tokens, split):
    """Cache writes of an hour cost their own rate where the split is whole, else all cost that of five minutes."""
    per = {"input": 1e-5, "output": 5e-5, "read": 1e-6, "five": 1.25e-5, "hour": 2e-5}
    five, hour = split if None not in split else (tokens[3], 0)
    want = tokens[0] * per["input"] + tokens[1] * per["output"] + tokens[2] * per["read"] + five * per["five"] + hour * per["hour"]
    r = spark.createDataFrame([row(1, "s", T, "m-a", None, None, tokens, split)], SCHEMA)
    assert pricing.price_requests(r, prices(spark)).first()["cost_usd"] == pytest.approx(want, abs=1e-9)


def line(kind="assistant", request="q1", out=5, ts="2026-03-02T08:15:27.944Z", **more):
    usage = {"input_tokens": "3", "output_tokens": out, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}
    doc = {"type": kind, "uuid": f"{request}-{out}", "parentUuid": None, "requestId": request, "sessionId": "s", "timestamp": ts, "isSidechain": False, "message": {"model": "m", "content": [{"type": "text", "text": "x"}], "usage": usage}}
    return json.dumps(doc | more)


def test_transcript_lines(spark, tmp_path):
    lines = [line(out=5), line(out=1004), line(out=0, message={"model": "<synthetic>", "content": [], "usage": {"input_tokens": 0}}), line("user"), line("summary"), '{"broken', "[1]", line(request=None), line(ts="yesterday"), line(request="q2", out=7), line(request="q2", message={"model": "m", "content": [], "usage": {}})]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.jsonl").write_text("\n".join(lines) + "\n")
    parsed = transcripts.parse_lines(read_transcripts(spark, str(tmp_path)))
    stats = transcripts.parse_stats(parsed).first()
    assert (stats["read"], stats["assistant"], stats["skipped"], stats["malformed"], stats["invalid"]) == (11, 7, 2, 2, 1)
    kept = {r["request_id"]: r["output_tokens"] for r in transcripts.collapse_requests(transcripts.extract_usage(parsed)).collect()}
    assert kept == {"q1": 1004, "q2": 7}
    found = transcripts.collapse_messages(transcripts.extract_messages(parsed))
    assert sorted(r["role"] for r in found.collect()) == ["assistant", "assistant", "user"]
    assert read_transcripts(spark, str(tmp_path / "none")).count() == 0


def test_messages_are_parsed_once(spark, tmp_path):
    """Both roles come from one read of the lines; users' lines all stay, equal ones too, and the last of each assistant request."""
    rows = [("f", 1, line("user")), ("f", 1, line("user")), ("f", 2, line("user")), ("f", 3, line(out=5)), ("f", 4, line(out=6)), ("g", 3, line(out=7)), ("f", 5, line(request=None))]
    spark.createDataFrame(rows, "file string, pos long, line string").write.parquet(str(tmp_path / "lines"))
    found = transcripts.collapse_messages(transcripts.extract_messages(transcripts.parse_lines(spark.read.parquet(str(tmp_path / "lines")))))
    assert sorted((r["file"], r["pos"], r["role"]) for r in found.collect()) == [("f", 1, "user"), ("f", 1, "user"), ("f", 2, "user"), ("f", 4, "assistant"), ("g", 3, "assistant")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_lines_are_told_without_their_schema(spark):
    """Statuses of odd lines; whether a line is an object is told without building the schema of all it holds."""
    odd = {"{}": "other", " \t\r\n{}": "other", "[1]": "malformed", "null": "malformed", '"{"': "malformed", "{": "malformed", "{'a':1}": "malformed", '{"a":NaN}': "malformed", '{"a":1,"a":2}': "malformed", "\u00a0{}": "malformed", "": "malformed"}
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(odd)], "file string, pos long, line string")
    parsed = transcripts.parse_lines(rows)
    assert {r["line"]: r["status"] for r in parsed.select("line", "status").collect()} == odd
    assert "schema_of_variant" not in transcripts.parse_stats(parsed)._jdf.queryExecution().optimizedPlan().toString().lower().replace("schemaofvariant", "schema_of_variant")


def test_statuses_are_told_by_one_parse(spark, sf):
    """Statuses and side chains are those of the whole parse, for odd lines too; the query of the stats reads no other fields."""
    from meterloom.plans import catalog

    usage = {"input_tokens": 1}
    odd = [{"message": m} for m in (None, 1, "", [], {}, [{"usage": usage}], *({"model": 5, "usage": u, "content": 1} for u in (None, 1, "", [], [{}], {}, {"input_tokens": {}}, {"cache_creation": 5})))]
    odd += [{"isSidechain": x} for x in (True, False, None, "true", "false", "x", 1, 0, 1.5, {}, [True])]
    odd += [{"sessionId": x} for x in (None, "", 5, 1.50, False, {}, [1])] + [{"ts": x} for x in (None, "", 7, "2026-03-02T08:15:60Z", "2026-03-02T08:15:27Z", "2026-02-30T08:15:27Z", ["2026-03-02T08:15:27Z"])]
    odd += [{"kind": x} for x in (None, "", "User", "user", "system", 1, ["assistant"], {"a": "assistant"})]
    texts = [line(**o) for o in odd] + ["{}", " \t\r\n{}", "[1]", "[{}]", "null", '"{"', "{", "{'a':1}", '{"a":NaN}', '{"a":1,"a":2}', "\u00a0{}", "\ufeff{}", "", None, "true"]
    texts += [line()[:-1] + x for x in ("", "} x", "}}", ',"a":1,"a":2}', ',"type":"user"}', ',"a":{"b":1,"b":2}}', ',"a":1e400}', ',"a":"\\ud800"}', ',"a":NaN}', ',"a":' + "[" * 1200 + "]" * 1200 + "}", ',"a":' + "1" * 1100 + "}")]
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, pos long, line string")
    told = lambda frame: {r["pos"]: (r["status"], r["is_sidechain"]) for r in frame.select("pos", "status", "is_sidechain").collect()}
    got, want = told(transcripts.line_statuses(rows)), told(transcripts.parse_lines(rows))
    assert [(texts[k], got[k], want[k]) for k in want if got[k][0] != want[k][0] or (got[k][1] != want[k][1] and want[k][0] != "malformed")] == []
    assert {s for s, _ in want.values()} == {"malformed", "other", "user", "assistant", "invalid"}
    assert transcripts.parse_stats(transcripts.line_statuses(rows)).collect() == transcripts.parse_stats(transcripts.parse_lines(rows)).collect()
    plan = catalog.QUERIES["transcript_stats"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") == 1 and "from_json" not in plan


def test_lines_are_dealt_out(spark, sf):
    """The lines are made and parsed in a few tasks for each core, though the events have one split."""
    from meterloom.plans import catalog, testbed

    assert spark.read.parquet(f"{sf}/events.parquet").rdd.getNumPartitions() == 1
    assert catalog._transcript_lines(spark, sf).rdd.getNumPartitions() >= testbed.SHARES * spark.sparkContext.defaultParallelism


def test_content_blocks(spark):
    content = [{"type": "text"}, {"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "1", "name": "n", "input": {}}, {"type": "tool_result", "tool_use_id": "1", "content": "c", "is_error": True}, {"type": "image"}]
    m = spark.createDataFrame([("u", json.dumps(content)), ("v", "no json")], "uuid string, content string")
    got = transcripts.content_blocks(m).orderBy("at").collect()
    assert [r["kind"] for r in got] == ["text", "thinking", "tool_use", "tool_result", "unknown"]
    assert got[0]["text"] == "" and got[2]["name"] == "n" and got[3]["is_error"] is True


def test_chains(spark):
    m = [("u1", None, "user", None, 1), ("a1", "u1", "assistant", "A", 2), ("u2", "a1", "user", None, 3), ("a2", "u2", "assistant", "B", 4), ("a3", "gone", "assistant", "C", 5)]
    m += [(f"l{i}", f"l{i - 1}" if i else None, "assistant", f"L{i}", 10 + i) for i in range(70)]
    frame = spark.createDataFrame(m, "uuid string, parent_uuid string, role string, request_id string, timestamp_ms long")
    requests = spark.createDataFrame([("B",), ("C",), ("none",), ("L63",), ("L64",)], "request_id string")
    got = {r["request_id"]: r for r in transcripts.request_chains(requests, frame).collect()}
    assert got["B"]["uuids"] == ["u1", "a1", "u2", "a2"] and got["B"]["chain_complete"]
    assert got["C"]["n_turns"] == 1 and not got["C"]["chain_complete"]
    assert got["none"]["n_turns"] == 0 and not got["none"]["chain_complete"]
    assert got["L63"]["n_turns"] == 64 and got["L63"]["chain_complete"]
    assert got["L64"]["n_turns"] == 64 and not got["L64"]["chain_complete"]


def body(records):
    return json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": records}]}]})


def record(name="api_request", session="s", nano="1772439327944000000", **attributes):
    kinds = {int: "intValue", float: "doubleValue", str: "stringValue"}
    pairs = [{"key": k.replace("__", "."), "value": {kinds[type(v)]: v}} for k, v in attributes.items()]
    pairs += [{"key": "session.id", "value": {"stringValue": session}}] if session else []
    return {"timeUnixNano": nano, "observedTimeUnixNano": "1772439327000000000", "body": {"stringValue": f"claude_code.{name}"}, "attributes": pairs}


def test_otlp(spark):
    rows = [(body([record(request_id="a", cost_usd=0.5, input_tokens="41", output_tokens=7, cache_read_tokens=3.9), record("user_prompt"), record(session=None), record("api_error", nano=None, error="x")]),), ("{}",), ("nope",)]
    bodies = spark.createDataFrame(rows, "body string")
    assert telemetry.rejected_bodies(bodies).count() == 1
    events = telemetry.parse_otlp_events(telemetry.log_records(bodies))
    got = telemetry.ingest_metrics(events).first()
    assert (got["ingested"], got["failed"], got["skipped"], got["newest_ms"]) == (2, 1, 1, 1772439327944)
    a = events.where("request_id = 'a'").first()
    assert (a["cost_usd"], a["input_tokens"], a["output_tokens"], a["cache_read_tokens"], a["event_type"]) == (0.5, 41, 7, 3, "api_request")
    assert events.where("event_type = 'api_error'").first()["timestamp_ms"] == 1772439327000


def test_reconcile_in_any_order(spark):
    live = row(1, "s", T, "m", None, 2.0, (1, 2, 3, 4))
    old = (*row(1, "t", T + 5, "n", "subagent", 9.0, (9, 9, 9, 9), (6, 3))[:-1], "backfill")
    none = (None, *row(2, "s", T, "m", None, 1.0, (1, 1, 1, 1))[1:])
    for order in ((0, 1), (1, 0)):
        frame = spark.createDataFrame([(*live, order[0]), (*live, 5), (*old, order[1]), (*none, 7), (*none, 8)], SCHEMA + ", arrival int")
        got = reconcile.reconcile_requests(frame).collect()
        assert len(got) == 3
        r = next(x for x in got if x["request_id"])
        assert (r["session_id"], r["cost_usd"], r["source"], r["query_source"], r["cache_creation_5m_tokens"]) == ("s", 2.0, "otel", "subagent", 6)


def test_capture_diff(spark):
    def rows(ids, source):
        return [(*row(i, "s", T + at, "m", None, 1.0, (1, 1, 1, 1))[:-1], source) for i, at in ids]

    t = spark.createDataFrame(rows([(1, 0), (2, 0), (3, 0), (4, 0)], "backfill"), SCHEMA)
    o = spark.createDataFrame(rows([(1, 0), (9, 0)], "otel"), SCHEMA)
    got = reconcile.capture_diff(t, o, T, T + 10).first()
    assert (got["transcript"], got["matched"], got["backfill_only"], got["otel_only"], got["missing_pct"]) == (4, 1, 3, 1, 75.0)
    near = spark.createDataFrame(rows([(1, -1000), (9, 0)], "otel"), SCHEMA)
    assert reconcile.capture_diff(t, near, T, T + 10).first()["matched"] == 1
    assert reconcile.capture_diff(t.where("false"), o, T, T + 10).first()["missing_pct"] is None


def test_sessions(spark):
    starts = spark.createDataFrame([('{"session_id":"s","cwd":"/a"}', 1), ('{"session_id":"s","cwd":""}', 5), ('{"session_id":""}', 2), ('{"session_id":3}', 2), ("x", 1)], "payload string, seen_ms long")
    hooks = reconcile.sessions_from_hooks(telemetry.parse_session_starts(starts))
    assert [tuple(r) for r in hooks.collect()] == [("s", "/a", 1, 5, "hook")]


def test_budgets_and_bands(spark):
    got = [value(spark, budgets.band_name(budgets.band(F.lit(p)))) for p in (50, 51, 75, 76, 90, 91)]
    assert got == ["green", "yellow", "yellow", "amber", "amber", "red"]
    assert value(spark, budgets.budget_percent(F.lit(0.125), F.lit(10.0))) == 1
    assert value(spark, budgets.budget_percent(F.lit(5.0), F.lit(0.0))) == 0


def test_batch_alerts(spark):
    rows = [row(i, "s", T + i * 60_000, "m", None, 6.0, (0, 0, 0, 0)) for i in range(40)]
    r = spark.createDataFrame(rows, SCHEMA)
    fired = [x["minute"] - T // 60_000 for x in alerts.burst_alerts(r, alerts.BurstRule(10.0, 10, 15)).orderBy("minute").collect()]
    assert fired == [1, 16, 31]
    quiet = alerts.burst_alerts(r, alerts.BurstRule(10.0, 10, 15), quiet=("00:00", "00:20")).collect()
    assert [x["minute"] - T // 60_000 for x in quiet] == [20, 35]
    steps = [(x["timestamp_ms"] - T, x["steps"]) for x in alerts.milestone_alerts(r, 50.0).orderBy("timestamp_ms").collect()]
    assert steps == [(8 * 60_000, 1), (16 * 60_000, 2), (24 * 60_000, 3), (33 * 60_000, 4)]


def test_growing_files(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "a.jsonl").write_text("one\ntwo\nthr")

    def step():
        q = tail_transcripts(spark, str(root)).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(out)).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["line"] for r in spark.read.parquet(str(out)).collect())

    assert step() == ["one", "two"]
    with (root / "a.jsonl").open("a") as f:
        f.write("ee\nfour\n")
    assert step() == ["four", "one", "three", "two"]


def test_unreadable_files(spark, tmp_path):
    from meterloom.sources.transcripts import unreadable_files

    assert unreadable_files(spark, str(tmp_path / "none")).count() == 0
    root = tmp_path / "deep" / "er"
    root.mkdir(parents=True)
    (root / "good.jsonl").write_text("one\ntwo\n")
    (root / "empty.jsonl").write_text("")
    (root / "bad.jsonl").write_text("three\n")
    (root / ".bad.jsonl.crc").write_bytes(b"crc\0\0\0\2\0\1\2\3\4")  # a checksum that is not the file's
    assert sorted(r["line"] for r in read_transcripts(spark, str(tmp_path)).collect()) == ["one", "two"]
    got = unreadable_files(spark, str(tmp_path)).collect()
    assert [(r["file"].rpartition("/")[2], r["length"]) for r in got] == [("bad.jsonl", 6)]


@pytest.mark.parametrize("span", [1, 3, 4, 7, 1000])
def test_spans_of_growing_files(tmp_path, span):
    from meterloom.sources.transcripts import GrowingFilesReader

    lines = ["", "one", "", "a longer line", "ünï", "x" * 20, ""]
    path = tmp_path / "a.jsonl"
    path.write_bytes("".join(f"{x}\n" for x in lines).encode() + b"unterminated")
    (tmp_path / "gone.jsonl").symlink_to(tmp_path / "nowhere")
    reader = GrowingFilesReader(str(tmp_path), span)
    places, at = [], 0
    for x in lines:
        places.append((str(path), at, x))
        at += len(x.encode()) + 1
    end = reader.latestOffset()
    assert end == {str(path): at}
    read = lambda start: [r for s in reader.partitions(start, end) for r in reader.read(s)]
    assert read({}) == places
    assert len(reader.partitions({}, end)) == -(-at // span)
    assert read({str(path): places[3][1]}) == places[3:]
    assert read(end) == []
    assert read({str(path): at + 5}) == places  # shorter than its offset


def test_stream_equals_batch(spark, tmp_path):
    from meterloom.streaming import requests as live

    bodies = [body([record(request_id="a", cost_usd=0.5), record(request_id="a", cost_usd=0.5), record(request_id="b", cost_usd=1.5)]), body([record(request_id="a", cost_usd=0.5)])]
    for i, text in enumerate(bodies):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(text + "\n")
    stream = live.stream_requests(telemetry.read_otlp_logs(spark, str(tmp_path / "in"), streaming=True))
    live.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "otel").awaitTermination()
    got = live.stored_requests(spark, str(tmp_path / "out"))
    assert sorted((r["request_id"], r["cost_usd"]) for r in got.collect()) == [("a", 0.5), ("b", 1.5)]


def test_stream_alerts(spark, tmp_path):
    from meterloom.streaming.alerts import AlertRules, stream_alerts

    rows = [row(i, "s", T + i * 60_000, "m", None, 6.0, (0, 0, 0, 0)) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    fired = stream_alerts(stream, AlertRules(alerts.BurstRule(10.0, 10, 15), step=50.0))
    q = fired.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("fired").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert not q.isActive
    got = spark.table("fired").collect()
    assert sorted((r["timestamp_ms"] - T) // 60_000 for r in got if r["kind"] == "burst") == [1, 16, 31]
    assert sorted((r["timestamp_ms"] - T) // 60_000 for r in got if r["kind"] == "step") == [8, 16, 24, 33]


def test_stream_alerts_after_backfill(spark, tmp_path):
    from meterloom.streaming.alerts import AlertRules, month_baseline, stream_alerts

    old = spark.createDataFrame([row(0, "s", T - 60_000, "m", None, 120.0, (0, 0, 0, 0))], SCHEMA)
    baseline = month_baseline(old, 50.0, "2026-01")
    assert [tuple(r) for r in baseline.collect()] == [("m", "2026-01", 120.0, 2)]
    rows = [row(i, "s", T + i * 60_000, "m", None, 6.0, (0, 0, 0, 0)) for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    fired = stream_alerts(stream, AlertRules(alerts.BurstRule(1000.0, 10, 15), step=50.0), initial=baseline)
    q = fired.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("later").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert not q.isActive
    assert [((r["timestamp_ms"] - T) // 60_000, r["steps"]) for r in spark.table("later").collect()] == [(4, 3)]


def test_budgets_of_any_window(spark):
    """Rows count by their own times in the hours that a window cuts; budgets of one name and amount stay apart."""
    at = lambda h, m=0: T + h * 3_600_000 + m * 60_000
    costs = [(at(9, 59), 1.0), (at(10, 10), 5.0), (at(10, 40), 7.0), (at(11, 5), 2.0), (at(12, 29), 4.0), (at(12, 30), 8.0)]
    r = spark.createDataFrame([row(i, "s", ts, "m", None, c, (0, 0, 0, 0)) for i, (ts, c) in enumerate(costs)], SCHEMA)
    windows = [("a", at(10, 30), at(12, 30)), ("b", at(10), at(11)), ("c", at(10, 5), at(10, 20)), ("d", at(13), at(14)), ("e", at(9, 30), at(10, 30)), ("e", at(10, 30), at(13))]
    table = spark.createDataFrame([(n, s, e, 10.0, True) for n, s, e in windows], "name string, start long, end long, amount double, enabled boolean")
    got = sorted((x["name"], x["spent"]) for x in budgets.budget_status(r, table).collect())
    assert got == sorted((n, sum(c for ts, c in costs if s <= ts < e)) for n, s, e in windows)
    small = table.limit(1).withColumn("amount", F.lit(0.2))
    assert budgets.checked_budgets(small).first()["amount"] == 1.0 and budgets.checked_budgets(small.withColumn("enabled", F.lit(False))).first()["amount"] == 0.2


def test_alert_settings():
    assert alerts.BurstRule.checked(0, 0, -1) == alerts.BurstRule() and alerts.BurstRule.checked(3.0, 5, 7) == alerts.BurstRule(3.0, 5, 7)
    assert alerts.checked_step(0) == alerts.DEFAULT_STEP and alerts.checked_step(7.5) == 7.5


def test_bursts_against_a_loop(spark):
    """Alerts of a long irregular series, by a plain loop over its minutes."""
    minutes = [k * k % 997 + 1000 * (k % 3) for k in range(400)]
    rows = [row(i, "s", T + m * 60_000, "m", None, 1.0 + m % 4, (0, 0, 0, 0)) for i, m in enumerate(minutes)]
    spend = {}
    for m in minutes:
        spend[m] = spend.get(m, 0.0) + 1.0 + m % 4
    fired, until = [], -1
    for m in sorted(spend):
        if m >= until and sum(v for k, v in spend.items() if m - 10 < k <= m) >= 14.0:
            fired.append(m)
            until = m + 15
    got = alerts.burst_alerts(spark.createDataFrame(rows, SCHEMA), alerts.BurstRule(14.0, 10, 15)).collect()
    assert sorted(x["minute"] - T // 60_000 for x in got) == fired and len(fired) > 5


def finished(frame, tmp_path, name, mode="append"):
    q = frame.writeStream.option("checkpointLocation", str(tmp_path / f"cp-{name}")).format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return frame.sparkSession.table(name).collect()


def test_stream_of_a_day(spark, tmp_path):
    from meterloom.operators.rollups import usage_summary
    from meterloom.streaming import requests as live

    rows = [row(i, f"s{i % 7}", T + i * 3_000_000, "m", None, 0.5 * i, (i, 2, 3, 4)) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["day"]: r for r in finished(live.stream_today(stream), tmp_path, "today", "complete")}
    for k, day in enumerate(sorted(got)):
        want = usage_summary(table.where((F.col("timestamp_ms") >= T + k * 86_400_000) & (F.col("timestamp_ms") < T + (k + 1) * 86_400_000))).first()
        assert all(got[day][c] == pytest.approx(want[c]) for c in ("cost_usd", "input_tokens", "requests", "sessions"))
    assert len(got) == 3
    exports.write_batch(table, str(tmp_path / "stored"), "otel", 0)
    assert live.today_exactly(spark, str(tmp_path / "stored"), T, T + 86_400_000).first()["requests"] == 29


def test_stream_of_sessions(spark, tmp_path):
    from meterloom.streaming import requests as live

    starts = [("a", "/one", 5), ("a", "", 9), ("b", "/two", 3), ("a", "/three", 7), ("", "/no", 1)]
    for i, (session, folder, seen) in enumerate(starts):
        (tmp_path / "in").mkdir(exist_ok=True)
        payload = json.dumps({"session_id": session, "cwd": folder})
        spark.createDataFrame([(payload, seen)], "payload string, seen_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("payload string, seen_ms long").parquet(str(tmp_path / "in"))
    live.stream_sessions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["session_id"]: (r["cwd"], r["first_seen_ms"], r["last_seen_ms"]) for r in live.stored_sessions(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": ("/three", 5, 9), "b": ("/two", 3, 3)}


def test_stream_of_transcripts(spark, tmp_path):
    """A growing file, read in two runs, gives what reading it whole does; the summary is written as CSV."""
    from meterloom.operators.rollups import usage_series
    from meterloom.streaming import requests as live

    root, lines = tmp_path / "in", [line(request=f"q{i}", out=10 + k) for i in range(4) for k in (1, 2)]
    root.mkdir()

    def run():
        live.stream_transcripts(tail_transcripts(spark, str(root)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)

    (root / "a.jsonl").write_text("\n".join(lines[:3]) + "\n" + lines[3][:20])
    run()
    (root / "a.jsonl").write_text("\n".join(lines) + "\n")
    run()
    stored, found = live.stored_transcripts(spark, str(tmp_path / "out"))
    assert {r["request_id"]: r["output_tokens"] for r in stored.collect()} == {f"q{i}": 12 for i in range(4)}
    assert found.count() == 4
    exports.export_summary(usage_series(stored.drop("arrival")).select("day", "requests", "output_tokens"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("part-*")).read_bytes() == b"day,requests,output_tokens\r\n2026-03-02,4,48\r\n"


def test_files_of_a_window(spark, tmp_path):
    import os

    from meterloom.sources.transcripts import read_window

    for name, at in (("old", T - 3_700_000), ("near", T - 3_500_000), ("new", T + 5)):
        (tmp_path / f"{name}.jsonl").write_text(name + "\n")
        os.utime(tmp_path / f"{name}.jsonl", (at / 1000, at / 1000))
    assert sorted(r["line"] for r in read_window(spark, str(tmp_path), T).collect()) == ["near", "new"]


def test_folders_in_file_order(spark):
    r = spark.createDataFrame([row(i, s, T + i, "m", None, None, (0, 0, 0, 0)) for i, s in enumerate(["a", "a", "b", None])], SCHEMA)
    folders = spark.createDataFrame([("a", None, 1), ("a", "/second", 7), ("a", "/first", 4), ("c", "/other", 1)], "session_id string, cwd string, pos long")
    got = {x["session_id"]: (x["cwd"], x["first_seen_ms"] - T, x["last_seen_ms"] - T) for x in reconcile.sessions_from_requests(r, folders).collect()}
    assert got == {"a": ("/first", 0, 1), "b": (None, 2, 2)}


def test_silence(spark, tmp_path):
    """A key that goes quiet raises one alert once the processing time has passed."""
    import time

    from meterloom.streaming.alerts import AlertRules, stream_alerts

    spark.createDataFrame([row(1, "s", T, "m", None, 1.0, (0, 0, 0, 0))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = AlertRules(alerts.BurstRule(1000.0, 10, 15), silence_minutes=0.02)
    fired = stream_alerts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), rules)
    q = fired.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("silence").trigger(processingTime="1 second").start()
    try:
        ends = time.time() + 90
        while time.time() < ends and not spark.table("silence").where("kind = 'silence'").count():
            time.sleep(1)
    finally:
        q.stop()
    assert [(r["key"], r["timestamp_ms"]) for r in spark.table("silence").where("kind = 'silence'").collect()] == [("m", T)]


def test_csv(spark, tmp_path):
    frame = spark.createDataFrame([("a,b", 'say "x"', None)], "a string, b string, c string").coalesce(1)
    exports.write_csv(frame, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert text == b'a,b,c\r\n"a,b","say ""x""",\r\n'


def test_seed(spark):
    requests, sessions = seed.seed_usage(spark, 4000, T)
    assert requests.count() == 4000 and sessions.count() == 600
    assert requests.where("event_type = 'api_error'").count() == 10
    assert requests.where("request_id is null or timestamp_ms is null").count() == 0
