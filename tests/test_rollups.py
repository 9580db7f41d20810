"""Rollups against a plain loop over a few made-up requests."""

from collections import defaultdict
from datetime import UTC, date, datetime, timedelta

import pytest

from meterloom.operators import rollups
from meterloom.operators.facets import Facets, apply_facets
from meterloom.plans.testbed import REQUEST_COLUMNS

T = 1767571200000  # 2026-01-05T00:00Z
DAY = 86_400_000
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
SPLIT = ("cache_creation_5m_tokens", "cache_creation_1h_tokens")
SCHEMA = (
    "request_id string, session_id string, timestamp_ms long, model string, query_source string, cost_usd double, input_tokens long, output_tokens long, "
    "cache_read_tokens long, cache_creation_tokens long, cache_creation_5m_tokens long, cache_creation_1h_tokens long, event_type string, error string, duration_ms long, source string"
)
FOLDERS = {"north": "/src/quay", "south": "/src/mill", "east": None, "idle": "/src/unused"}


def row(i, session, ts, model, who, cost, tokens, split=(None, None), kind="api_request"):
    return (f"r{i}", session, ts, model, who, cost, *tokens, *split, kind, None, None, "otel")


#: Every tenth of an hour from T on: sessions in turn, one of them without an entry, and some without a session.
ROWS = [
    row(
        i,
        ("north", "south", "east", "west", None)[i % 5],
        T + i * 360_000 + (3 * DAY if i > 14 else 0),
        None if i % 7 == 6 else ("large", "small")[i % 2],
        (None, "user", "subagent")[i % 3],
        None if i % 4 == 3 else 0.25 * i,
        (3 * i, i, 100 * i, 8 * i),
        (5 * i, 3 * i) if i % 6 == 0 else (None, None),
        "api_error" if i % 7 == 6 else "api_request",
    )
    for i in range(1, 24)
]


def records(keep=lambda r: True):
    return [r for r in (dict(zip(REQUEST_COLUMNS, x, strict=True)) for x in ROWS) if keep(r)]


def total(rows):
    """The measures of some rows, by hand."""
    found = {"cost_usd": round(sum(r["cost_usd"] or 0 for r in rows), 6)} | {t: sum(r[t] for r in rows) for t in TOKENS}
    for part in SPLIT:
        known = [r[part] for r in rows if r[part] is not None]
        found[part] = sum(known) if known else None
    calls = [r for r in rows if r["event_type"] == "api_request"]
    return found | {"requests": len(calls), "errors": len(rows) - len(calls), "unpriced": sum(r["cost_usd"] is None for r in calls)}


def grouped(rows, key):
    groups = defaultdict(list)
    for r in rows:
        groups[key(r)].append(r)
    return {k: total(v) for k, v in groups.items()}


def day_of(r):
    return datetime.fromtimestamp(r["timestamp_ms"] / 1000, UTC).date()


def folder_of(r):
    return FOLDERS.get(r["session_id"])


def same(got, want):
    """Whether a row has what a dict says."""
    return {k: got[k] for k in want} == want


@pytest.fixture(scope="module")
def tables(spark):
    requests = spark.createDataFrame(ROWS, SCHEMA)
    assert requests.columns == list(REQUEST_COLUMNS)
    return requests, spark.createDataFrame(list(FOLDERS.items()), "session_id string, cwd string")


FACETS = [
    (Facets(), lambda r: True),
    (Facets(model="small"), lambda r: r["model"] == "small"),
    (Facets(project="/src/mill"), lambda r: folder_of(r) == "/src/mill"),
    (Facets(unknown_project=True), lambda r: folder_of(r) is None),
    (Facets(source="main"), lambda r: r["query_source"] != "subagent"),
    (Facets(source="subagent"), lambda r: r["query_source"] == "subagent"),
    (Facets(start=T, end=T + DAY), lambda r: r["timestamp_ms"] < T + DAY),
    (Facets(start=T + DAY, end=T + 9 * DAY, model="large", source="main", unknown_project=True), lambda r: day_of(r) > date(2026, 1, 5) and r["model"] == "large" and r["query_source"] != "subagent" and folder_of(r) is None),
    (Facets(model="none"), lambda r: False),
]


@pytest.mark.parametrize("case", range(len(FACETS)))
def test_summary(tables, case):
    facets, keep = FACETS[case]
    kept = records(keep)
    got = rollups.usage_summary(apply_facets(*tables, facets)).first()
    assert same(got, total(kept) | {"sessions": len({r["session_id"] for r in kept} - {None})})


def test_series(tables):
    by_day = grouped(records(), day_of)
    first, last = min(by_day), max(by_day)
    every = [first + timedelta(k) for k in range((last - first).days + 1)]
    got = rollups.usage_series(tables[0]).collect()
    assert [r["day"] for r in got] == every and len(every) > len(by_day)
    assert all(same(r, by_day.get(r["day"], total([]))) for r in got)
    wide = rollups.usage_series(tables[0], start=T - 2 * DAY, end=T + 6 * DAY).collect()
    assert [r["day"] for r in wide] == [date(2026, 1, 3) + timedelta(k) for k in range(8)]
    assert all(same(r, by_day.get(r["day"], total([]))) for r in wide)
    narrow = rollups.usage_series(tables[0], start=T + DAY, end=T + 2 * DAY).collect()
    assert [(r["day"], r["requests"], r["cost_usd"]) for r in narrow] == [(date(2026, 1, 6), by_day[date(2026, 1, 6)]["requests"] if date(2026, 1, 6) in by_day else 0, by_day.get(date(2026, 1, 6), total([]))["cost_usd"])]
    assert [r["day"] for r in rollups.usage_series(tables[0], most=2).collect()] == every[-2:]
    assert rollups.usage_series(tables[0].where("false")).count() == 0
    plan = rollups.usage_series(tables[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    by_model = {(r["day"], r["model"]): r for r in rollups.usage_series_by_model(tables[0]).collect()}
    want = grouped(records(), lambda r: (day_of(r), r["model"]))
    assert set(by_model) == set(want) and all(same(by_model[k], want[k]) for k in want)
    by_project = {(r["day"], r["cwd"]): r for r in rollups.usage_series_by_project(*tables).collect()}
    want = grouped(records(), lambda r: (day_of(r), folder_of(r)))
    assert set(by_project) == set(want) and all(same(by_project[k], want[k]) for k in want)


def test_sessions_and_projects(tables):
    own = records(lambda r: r["session_id"] is not None)
    want = grouped(own, lambda r: r["session_id"])
    got = {r["session_id"]: r for r in rollups.session_rollups(*tables).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        times = [x["timestamp_ms"] for x in own if x["session_id"] == k]
        models = sorted({x["model"] for x in own if x["session_id"] == k} - {None})
        assert same(r, want[k] | {"first_ms": min(times), "last_ms": max(times), "duration_ms": max(times) - min(times), "models": models, "cwd": FOLDERS.get(k)})
    value = {"cost": "cost_usd", "tokens": "total_tokens", "duration": "duration_ms", "start": "first_ms"}
    for by, column in value.items():
        for descending in (True, False):
            order = sorted(got, key=lambda k: ((-1 if descending else 1) * got[k][column], k))  # noqa: B023
            assert [r["session_id"] for r in rollups.sorted_sessions(rollups.session_rollups(*tables), by, descending).collect()] == order
            paged = rollups.session_page(*tables, by, descending, limit=2, offset=1).collect()
            assert paged == [got[k] for k in order[1:3]] or [r.asDict() for r in paged] == [{c: got[k][c] for c in paged[0].asDict()} for k in order[1:3]]
    want = grouped(records(), folder_of)
    projects = rollups.project_rollups(*tables).collect()
    assert {r["cwd"] for r in projects} == set(want) and all(same(r, want[r["cwd"]]) for r in projects)
    costs = [r["cost_usd"] for r in projects]
    assert costs == sorted(costs, reverse=True)


def test_plans_have_no_nested_loop(tables, spark):
    for frame in (
        apply_facets(*tables, Facets(unknown_project=True)),
        rollups.project_rollups(*tables),
        rollups.usage_series_by_project(*tables),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_views_agree(tables):
    got = rollups.reconcile_check(*tables).first()
    assert got["views"] == 6 and got["requests_agree"] and got["errors_agree"] and got["tokens_agree"]


def test_views_agree_over_more_days_than_a_series_shows(tables, spark):
    old = spark.createDataFrame([row(99, "north", T - 3000 * DAY, "large", None, 1.0, (1, 1, 1, 1))], SCHEMA)
    got = rollups.reconcile_check(tables[0].unionByName(old), tables[1]).first()
    assert got["requests_agree"] and got["tokens_agree"]
