"""The registered queries, each with its DuckDB SQL where there is one."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import DAY_MS, EPOCH, clamped_days, is_quiet, local_date, minutes_between, month_key, month_window, trailing_days
from ..functions.parsing import iso_ms, project_name
from ..operators import alerts, budgets, partials, pricing, reconcile, rollups, transcripts
from ..operators.facets import Facets, apply_facets, date_bounds
from ..sources import exports, tables, telemetry
from ..sources.files import work_folder
from .testbed import (
    ARRIVALS_SQL, MESSAGES_SQL, NOW_MS, ORDER_REQUESTS_SQL, REQUESTS_SQL, SESSIONS_SQL, arrivals, messages, order_requests, requests, sessions,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MIDNIGHT = NOW_MS - DAY_MS
TODAY = "2024-01-30"
MONTH_START = NOW_MS - 30 * DAY_MS
TOKENS = "input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens"
TOKEN_SUM = "input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens"
SUMS = """round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens,
  CAST(sum(cache_creation_5m_tokens) AS BIGINT) AS cache_creation_5m_tokens, CAST(sum(cache_creation_1h_tokens) AS BIGINT) AS cache_creation_1h_tokens,
  count(*) FILTER (event_type = 'api_request') AS requests, count(*) FILTER (event_type = 'api_error') AS errors,
  count(*) FILTER (event_type = 'api_request' AND cost_usd IS NULL) AS unpriced"""
DAY = "CAST(make_timestamp(timestamp_ms * 1000) AS DATE)"
RS = f"WITH {REQUESTS_SQL}, {SESSIONS_SQL}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def cents(frame: DataFrame) -> DataFrame:
    """Costs of the larger table, whose sums leave no room for a millionth in a double."""
    return frame.withColumn("cost_usd", F.round("cost_usd", 2))


def cents_sql(with_: str, select: str) -> str:
    return f"{with_} SELECT * REPLACE (round(cost_usd, 2) AS cost_usd) FROM ({select})"


def faceted(name: str, facets: Facets, where: str) -> None:
    """A usage summary under facets."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rollups.usage_summary(apply_facets(requests(spark, d), sessions(spark, d), facets))

    query(name, f"{RS} SELECT {SUMS}, count(DISTINCT session_id) AS sessions FROM requests WHERE {where}")(run)


MONTH = f"timestamp_ms >= {MIDNIGHT - 29 * DAY_MS} AND timestamp_ms < {NOW_MS}"
WEEK = f"timestamp_ms >= {MIDNIGHT - 6 * DAY_MS} AND timestamp_ms < {NOW_MS}"
IN_PROJECT = "session_id IN (SELECT session_id FROM sessions WHERE cwd = '/home/dev/NATION_3')"
UNKNOWN = "NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = requests.session_id AND cwd IS NOT NULL)"
faceted("usage_summary_all", Facets(), "true")
faceted("usage_summary_week_model_main", Facets.preset("week", MIDNIGHT, model="m-view", source="main"), f"{WEEK} AND model = 'm-view' AND query_source IS DISTINCT FROM 'subagent'")
faceted("usage_summary_month_subagent", Facets.preset("month", MIDNIGHT, source="subagent"), f"{MONTH} AND query_source = 'subagent'")
faceted("usage_summary_project", Facets.preset("month", MIDNIGHT, project="/home/dev/NATION_3"), f"{MONTH} AND {IN_PROJECT}")
faceted("usage_summary_unknown_project", Facets.preset("month", MIDNIGHT, unknown_project=True), f"{MONTH} AND {UNKNOWN}")
faceted("usage_summary_with_session", Facets(sessionless=False), "session_id IS NOT NULL")


@query("stored_month_summary", SQL["usage_summary_project"])
def _(spark, d):
    """A month of a project from the table by day, of which only the month's folders are read."""
    days = tables.DayTable(spark, work_folder(spark, "days"))
    days.replace(requests(spark, d))
    facets = Facets.preset("month", MIDNIGHT, project="/home/dev/NATION_3")
    return rollups.usage_summary(apply_facets(days.read(facets), sessions(spark, d), facets))


@query("partials_month_subagent", SQL["usage_summary_month_subagent"])
def _(spark, d):
    """A month of subagents from daily partials alone, numbered and written before."""
    r, folder = requests(spark, d), work_folder(spark, "partials")
    partials.number_sessions(r).write.parquet(f"{folder}/numbers")
    partials.daily_partials(r, spark.read.parquet(f"{folder}/numbers")).write.partitionBy("day").parquet(f"{folder}/daily")
    month = F.col("day").between(F.date_sub(F.lit(TODAY).cast("date"), 29), F.lit(TODAY).cast("date"))
    return partials.summary_of_partials(spark.read.parquet(f"{folder}/daily").where(month & ~F.col("main")))


@query("line_usage_summary", cents_sql(f"WITH {ORDER_REQUESTS_SQL}", f"SELECT {SUMS}, count(DISTINCT session_id) AS sessions FROM requests WHERE query_source IS DISTINCT FROM 'subagent'"))
def _(spark, d):
    r, s = order_requests(spark, d)
    return cents(rollups.usage_summary(apply_facets(r, s, Facets(source="main"))))


@query("usage_summary_dates", f"{RS} SELECT {SUMS}, count(DISTINCT session_id) AS sessions FROM requests WHERE {DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def _(spark, d):
    lo, hi = date_bounds("2024-01-05", "2024-01-09", "UTC")
    return rollups.usage_summary(requests(spark, d).where((F.col("timestamp_ms") >= lo) & (F.col("timestamp_ms") < hi)))


SERIES_SQL = f"""{RS}, bounds AS (SELECT min({DAY}) AS lo, max({DAY}) AS hi FROM requests),
spine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds),
days AS (SELECT {DAY} AS day, {SUMS} FROM requests GROUP BY 1),
series AS (
  SELECT day, coalesce(cost_usd, 0) AS cost_usd, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*TOKENS.split(', '), 'requests', 'errors', 'unpriced'))}, cache_creation_5m_tokens, cache_creation_1h_tokens
  FROM spine LEFT JOIN days USING (day)
)"""


@query("usage_series_daily", f"{SERIES_SQL} SELECT * FROM series")
def _(spark, d):
    return rollups.usage_series(requests(spark, d))


@query("usage_series_by_model", f"{RS} SELECT {DAY} AS day, model, {SUMS} FROM requests GROUP BY 1, 2")
def _(spark, d):
    return rollups.usage_series_by_model(requests(spark, d))


@query("usage_series_by_project", f"{RS} SELECT {DAY.replace('timestamp_ms', 'r.timestamp_ms')} AS day, cwd, {SUMS} FROM requests r LEFT JOIN (SELECT session_id, cwd FROM sessions) s USING (session_id) GROUP BY 1, 2")
def _(spark, d):
    return rollups.usage_series_by_project(requests(spark, d), sessions(spark, d))


@query("line_series_by_project", cents_sql(f"WITH {ORDER_REQUESTS_SQL}", f"SELECT {DAY} AS day, cwd, {SUMS} FROM requests LEFT JOIN sessions USING (session_id) GROUP BY 1, 2"))
def _(spark, d):
    return cents(rollups.usage_series_by_project(*order_requests(spark, d)))


SESSION_SQL = f"""ses AS (
  SELECT r.session_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, {SUMS}, array_to_string(list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)), ',') AS models
  FROM requests r WHERE r.session_id IS NOT NULL GROUP BY 1
), rollup_rows AS (
  SELECT ses.*, cwd, {TOKEN_SUM} AS total_tokens, last_ms - first_ms AS duration_ms FROM ses LEFT JOIN (SELECT session_id, cwd FROM sessions) USING (session_id)
)"""


def _session_rollups(spark, d):
    return rollups.session_rollups(requests(spark, d), sessions(spark, d)).withColumn("models", F.array_join("models", ","))


@query("session_rollups", f"{RS}, {SESSION_SQL} SELECT * REPLACE (coalesce(models, '') AS models) FROM rollup_rows")
def _(spark, d):
    return rollups.sorted_sessions(_session_rollups(spark, d))


@query("session_page_by_cost", f"{RS}, {SESSION_SQL} SELECT session_id, cost_usd FROM rollup_rows ORDER BY cost_usd DESC, session_id LIMIT 50 OFFSET 10")
def _(spark, d):
    return rollups.session_page(requests(spark, d), sessions(spark, d), limit=50, offset=10).select("session_id", "cost_usd")


@query("session_page_by_start", f"{RS}, {SESSION_SQL} SELECT session_id, first_ms FROM rollup_rows ORDER BY first_ms, session_id LIMIT 200")
def _(spark, d):
    return rollups.page(rollups.sorted_sessions(_session_rollups(spark, d), "start", descending=False)).select("session_id", "first_ms")


@query("session_page_by_tokens", f"{RS}, {SESSION_SQL} SELECT session_id, total_tokens FROM rollup_rows ORDER BY total_tokens DESC, session_id LIMIT 200")
def _(spark, d):
    return rollups.session_page(requests(spark, d), sessions(spark, d), "tokens").select("session_id", "total_tokens")


@query("session_page_by_duration", f"{RS}, {SESSION_SQL} SELECT session_id, duration_ms, cwd FROM rollup_rows ORDER BY duration_ms DESC, session_id LIMIT 100")
def _(spark, d):
    return rollups.session_page(requests(spark, d), sessions(spark, d), "duration", limit=100).select("session_id", "duration_ms", "cwd")


@query("line_session_rollups", cents_sql(f"WITH {ORDER_REQUESTS_SQL}, {SESSION_SQL}", "SELECT * REPLACE (coalesce(models, '') AS models) FROM rollup_rows"))
def _(spark, d):
    return cents(rollups.session_rollups(*order_requests(spark, d)).withColumn("models", F.array_join("models", ",")))


@query("session_model_mix", f"{RS} SELECT session_id, model, {SUMS} FROM requests WHERE session_id IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return rollups.model_mix(requests(spark, d))


ONE_SESSION = "s-42-2024-01-15"


@query("session_models", f"{RS} SELECT model, {SUMS} FROM requests WHERE session_id = 'orphan-42' GROUP BY 1")
def _(spark, d):
    return rollups.session_models(requests(spark, d), "orphan-42")


@query(
    "session_timeline",
    f"{RS} SELECT request_id, timestamp_ms, model, cost_usd, (SELECT count(*) FROM requests WHERE session_id = '{ONE_SESSION}') AS total_rows FROM requests WHERE session_id = '{ONE_SESSION}' ORDER BY timestamp_ms, request_id LIMIT 1000",
)
def _(spark, d):
    return rollups.session_timeline(requests(spark, d), ONE_SESSION).select("request_id", "timestamp_ms", "model", "cost_usd", "total_rows")


@query("session_folder", f"{RS} SELECT session_id, cwd FROM sessions WHERE session_id = '{ONE_SESSION}'")
def _(spark, d):
    return rollups.session_folder(sessions(spark, d), ONE_SESSION)


@query("session_folder_names", rf"{RS} SELECT session_id, coalesce(regexp_extract(cwd, '([^/]+)/*$', 1), '(unknown project)') AS project FROM sessions")
def _(spark, d):
    return sessions(spark, d).select("session_id", project_name(F.col("cwd")).alias("project"))


PROJECT_SQL = f"""projects AS (SELECT cwd, {SUMS}, count(DISTINCT r.session_id) AS sessions FROM requests r LEFT JOIN (SELECT session_id, cwd FROM sessions) USING (session_id) GROUP BY 1)"""


@query("project_rollups", f"{RS}, {PROJECT_SQL} SELECT * FROM projects")
def _(spark, d):
    return rollups.project_rollups(requests(spark, d), sessions(spark, d))


@query("line_project_rollups", cents_sql(f"WITH {ORDER_REQUESTS_SQL}, {PROJECT_SQL}", "SELECT * FROM projects"))
def _(spark, d):
    return cents(rollups.project_rollups(*order_requests(spark, d)))


@query("project_cost_share", f"{RS}, {PROJECT_SQL} SELECT cwd, cost_usd, CASE WHEN sum(cost_usd) OVER () > 0 THEN round(cost_usd / sum(cost_usd) OVER (), 9) END AS share FROM projects")
def _(spark, d):
    return rollups.cost_share(rollups.project_rollups(requests(spark, d), sessions(spark, d)), "cwd")


def _today(spark, d):
    return apply_facets(requests(spark, d), sessions(spark, d), Facets.preset("day", MIDNIGHT))


TODAY_SQL = f"timestamp_ms >= {MIDNIGHT} AND timestamp_ms < {NOW_MS}"
faceted("today_metrics", Facets.preset("day", MIDNIGHT), TODAY_SQL)


@query("today_top_projects", f"{RS}, t AS (SELECT * FROM requests WHERE {TODAY_SQL} AND event_type = 'api_request') SELECT cwd, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd FROM t LEFT JOIN (SELECT session_id, cwd FROM sessions) USING (session_id) GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 3")
def _(spark, d):
    return rollups.top_projects(_today(spark, d), sessions(spark, d))


@query(
    "daily_costs",
    f"{RS}, spine AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - INTERVAL 39 DAY, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day), days AS (SELECT {DAY} AS day, {SUMS} FROM requests GROUP BY 1) SELECT day, coalesce(cost_usd, 0) AS cost_usd, coalesce(requests, 0) AS requests FROM spine LEFT JOIN days USING (day)",
)
def _(spark, d):
    return rollups.daily_costs(requests(spark, d), F.lit(TODAY).cast("date"), 40)


@query("priced_spend", f"{RS} SELECT round(coalesce(sum(cost_usd), 0), 6) AS spend, count(*) FILTER (event_type = 'api_request' AND cost_usd IS NULL) AS unpriced FROM requests WHERE timestamp_ms >= {MIDNIGHT - 3 * DAY_MS}")
def _(spark, d):
    return rollups.priced_spend(requests(spark, d), MIDNIGHT - 3 * DAY_MS)


@query("window_cost", f"{RS} SELECT round(coalesce(sum(cost_usd), 0), 6) AS cost_usd FROM requests WHERE {WEEK}")
def _(spark, d):
    return rollups.window_cost(apply_facets(requests(spark, d), sessions(spark, d), Facets.preset("week", MIDNIGHT)))


@query("live_capture_stats", f"{RS} SELECT count(*) AS live_rows, max(timestamp_ms) AS newest_ms, greatest(max(timestamp_ms), {MIDNIGHT}) AS freshest_ms FROM requests WHERE source = 'otel'")
def _(spark, d):
    return rollups.live_capture_stats(requests(spark, d), MIDNIGHT)


@query(
    "facet_options",
    f"""{RS} SELECT DISTINCT 'project' AS kind, cwd AS value FROM sessions WHERE cwd IS NOT NULL UNION ALL SELECT DISTINCT 'model', model FROM requests WHERE model IS NOT NULL
UNION ALL SELECT 'unknown', NULL WHERE EXISTS (SELECT 1 FROM sessions WHERE cwd IS NULL) OR EXISTS (SELECT 1 FROM requests WHERE session_id IS NULL)""",
)
def _(spark, d):
    return rollups.facet_options(requests(spark, d), sessions(spark, d))


@query("series_anchor", f"{RS} SELECT min({DAY}) AS day FROM requests")
def _(spark, d):
    return rollups.series_anchor(requests(spark, d))


HIT = "round(CASE WHEN sum(cache_read_tokens) + sum(input_tokens) <> 0 THEN sum(cache_read_tokens) / (sum(cache_read_tokens) + sum(input_tokens)) END, 9) AS hit_rate"


@query("cache_hit_rate_by_model", f"{RS} SELECT model, {HIT} FROM requests GROUP BY 1")
def _(spark, d):
    return rollups.cache_hits(requests(spark, d), F.col("model")).select("model", "hit_rate")


@query("cache_hit_rate_by_session", f"{RS} SELECT session_id, {HIT} FROM requests GROUP BY 1")
def _(spark, d):
    return rollups.cache_hits(requests(spark, d), F.col("session_id")).select("session_id", "hit_rate")


@query("cache_split_daily", f"{SERIES_SQL} SELECT day, coalesce(cache_creation_5m_tokens, 0) AS tokens_5m, coalesce(cache_creation_1h_tokens, 0) AS tokens_1h, greatest(cache_creation_tokens - coalesce(cache_creation_5m_tokens, 0) - coalesce(cache_creation_1h_tokens, 0), 0) AS unsplit FROM series")
def _(spark, d):
    return rollups.cache_split(rollups.usage_series(requests(spark, d)))


@query("peak_day", f"{SERIES_SQL} SELECT day, cost_usd FROM series ORDER BY cost_usd DESC, day LIMIT 1")
def _(spark, d):
    return rollups.peak_day(rollups.usage_series(requests(spark, d)))


@query(
    "top_models_daily",
    f"""{RS}, k AS (SELECT model, round(coalesce(sum(cost_usd), 0), 6) AS whole FROM requests GROUP BY 1), top AS (SELECT model, true AS top FROM k ORDER BY whole DESC, model NULLS FIRST LIMIT 2)
SELECT {DAY} AS day, CASE WHEN top THEN coalesce(r.model, '(none)') ELSE 'Other' END AS label, round(coalesce(sum(cost_usd), 0), 6) AS cost_usd FROM requests r LEFT JOIN top ON r.model IS NOT DISTINCT FROM top.model GROUP BY 1, 2""",
)
def _(spark, d):
    return rollups.top_keys_by_day(requests(spark, d), "model", 2)


@query(
    "reconcile_check",
    f"""{RS}, f AS (SELECT *, event_type = 'api_request' AS q, event_type = 'api_error' AS x, {TOKEN_SUM} AS t FROM requests),
v AS (
  SELECT count(*) FILTER (q) AS r, count(*) FILTER (x) AS e, sum(t) AS t FROM f
  UNION ALL SELECT sum(r), sum(e), sum(t) FROM (SELECT {DAY} AS day, count(*) FILTER (q) AS r, count(*) FILTER (x) AS e, sum(t) AS t FROM f GROUP BY 1)
  UNION ALL SELECT sum(r), sum(e), sum(t) FROM (SELECT {DAY} AS day, model, count(*) FILTER (q) AS r, count(*) FILTER (x) AS e, sum(t) AS t FROM f GROUP BY 1, 2)
  UNION ALL SELECT sum(r), sum(e), sum(t) FROM (SELECT {DAY} AS day, cwd, count(*) FILTER (q) AS r, count(*) FILTER (x) AS e, sum(t) AS t FROM f LEFT JOIN (SELECT session_id, cwd FROM sessions) USING (session_id) GROUP BY 1, 2)
  UNION ALL SELECT sum(r), sum(e), sum(t) FROM (SELECT session_id, count(*) FILTER (q) AS r, count(*) FILTER (x) AS e, sum(t) AS t FROM f GROUP BY 1)
  UNION ALL SELECT sum(r), sum(e), sum(t) FROM (SELECT cwd, count(*) FILTER (q) AS r, count(*) FILTER (x) AS e, sum(t) AS t FROM f LEFT JOIN (SELECT session_id, cwd FROM sessions) USING (session_id) GROUP BY 1)
)
SELECT count(*) AS views, min(r) = max(r) AS requests_agree, min(e) = max(e) AS errors_agree, min(t) = max(t) AS tokens_agree, CAST(max(r) AS BIGINT) AS requests, CAST(max(e) AS BIGINT) AS errors, CAST(max(t) AS BIGINT) AS tokens FROM v""",
)
def _(spark, d):
    return rollups.reconcile_check(requests(spark, d), sessions(spark, d))


# Prices

#: Name, provider, input and output rate of the price list's entries.
PRICES = (("m-click", "", 1e-5, 5e-5), ("m-view-20240101", "acme", 3e-6, 1.5e-5), ("m-view-20231001", "acme", 2e-6, 1.5e-5), ("m-purchase", "other", 1e-6, 5e-6), ("x-signup", "acme", 1e-6, 1e-6))


def _price_list(spark):
    entries = {n: {"input_cost_per_token": i, "output_cost_per_token": o} | ({"litellm_provider": p} if p else {}) for n, p, i, o in PRICES}
    entries["m-purchase-batch"] = {"input_cost_per_token": -1.0, "output_cost_per_token": 0.0}
    texts = spark.createDataFrame([(json.dumps(entries),)], "text string")
    return telemetry.parse_price_list(texts, "m-", "acme")


PRICES_SQL = """prices(model, input_rate, output_rate) AS (VALUES ('m-click', 1e-5, 5e-5), ('m-view-20240101', 3e-6, 1.5e-5), ('m-view-20231001', 2e-6, 1.5e-5))"""


@query(
    "resolve_prices",
    f"""WITH {REQUESTS_SQL}, {PRICES_SQL}, names AS (SELECT DISTINCT CASE WHEN event_type = 'api_request' AND timestamp_ms % 3 = 0 THEN 'acme/' || model || ' ' ELSE model END AS model FROM requests)
SELECT n.model, round(coalesce(e.input_rate, (SELECT arg_max(input_rate, p.model) FROM prices p WHERE regexp_replace(p.model, '-[0-9]{{8}}$', '') = b.bare AND p.model <> b.bare)), 12) AS input_rate
FROM names n, LATERAL (SELECT trim(replace(n.model, 'acme/', '')) AS bare) b LEFT JOIN prices e ON e.model = b.bare""",
)
def _(spark, d):
    odd = (F.col("event_type") == "api_request") & (F.col("timestamp_ms") % 3 == 0)
    names = requests(spark, d).select(F.when(odd, F.concat(F.lit("acme/"), "model", F.lit(" "))).otherwise(F.col("model")).alias("model"))
    return pricing.resolve_prices(names, _price_list(spark)).select("model", F.round("input_rate", 12).alias("input_rate"))


@query(
    "price_requests",
    f"""WITH {REQUESTS_SQL} SELECT request_id, round(CASE WHEN cost_usd IS NOT NULL OR event_type <> 'api_request' THEN cost_usd
  WHEN model IN ('m-click', 'm-view') THEN
    input_tokens * i + output_tokens * o + cache_read_tokens * i * 0.1
    + CASE WHEN cache_creation_5m_tokens IS NULL THEN cache_creation_tokens * i * 1.25 ELSE cache_creation_5m_tokens * i * 1.25 + cache_creation_1h_tokens * i * 2 END
  END, 9) AS cost_usd
FROM (SELECT *, CASE model WHEN 'm-click' THEN 1e-5 ELSE 3e-6 END AS i, CASE model WHEN 'm-click' THEN 5e-5 ELSE 1.5e-5 END AS o FROM requests)""",
)
def _(spark, d):
    return pricing.price_requests(requests(spark, d), _price_list(spark)).select("request_id", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "layered_prices",
    """WITH base AS (SELECT p_brand || '/' || p_size AS model, min(p_retailprice) AS input_rate FROM part GROUP BY 1),
newer AS (SELECT p_brand || '/' || p_size AS model, max(p_retailprice) AS input_rate FROM part WHERE p_type = 'ECONOMY' GROUP BY 1)
SELECT model, coalesce(n.input_rate, b.input_rate) AS input_rate FROM base b FULL JOIN newer n USING (model)""",
)
def _(spark, d):
    """The lowest price of each brand and size, and above it the highest of one type."""
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("model", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")))
    layer = lambda rows, rate: rows.groupBy("model").agg(*[rate("p_retailprice").alias(r) for r in pricing.RATES])
    return pricing.layer_prices(layer(part, F.min), layer(part.where("p_type = 'ECONOMY'"), F.max)).select("model", "input_rate")


@query("first_per_request", f"WITH {ARRIVALS_SQL} SELECT request_id, source, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY timestamp_ms, source) AS k FROM arrivals) WHERE k = 1")
def _(spark, d):
    return pricing.first_per_request(arrivals(spark, d)).select("request_id", "source", "output_tokens")


# Reconciliation

RECONCILED = f"""WITH {ARRIVALS_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival) AS k FROM arrivals WHERE source = 'otel') WHERE k = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival) AS k FROM arrivals WHERE source = 'backfill') WHERE k = 1)"""


@query(
    "reconcile_requests",
    f"""{RECONCILED} SELECT coalesce(l.request_id, b.request_id) AS request_id, CASE WHEN l.request_id IS NULL THEN b.output_tokens ELSE l.output_tokens END AS output_tokens,
  CASE WHEN l.request_id IS NULL THEN 'backfill' ELSE 'otel' END AS source, coalesce(l.query_source, b.query_source) AS query_source,
  coalesce(l.cache_creation_5m_tokens, b.cache_creation_5m_tokens) AS cache_creation_5m_tokens FROM l FULL JOIN b ON l.request_id = b.request_id""",
)
def _(spark, d):
    merged = reconcile.reconcile_requests(arrivals(spark, d))
    return merged.select("request_id", "output_tokens", "source", "query_source", "cache_creation_5m_tokens")


@query("stored_requests", SQL["reconcile_requests"])
def _(spark, d):
    """The reconciled requests from the store, into which the arrivals went in three batches of each source."""
    a, store, given = arrivals(spark, d), tables.RequestStore(spark, work_folder(spark, "requests")), work_folder(spark, "deliveries")
    last = F.lit(a.agg(F.max("arrival")).first()[0] or 0)
    # The batches are written as they would come, in one pass; a batch then reads its own rows alone.
    dealt = a.withColumns({"from": F.col("source"), "i": F.floor(F.greatest("arrival", F.lit(0)) * 3 / (last + 1)).cast("int")})
    dealt.write.partitionBy("from", "i").parquet(given)
    batches = spark.read.schema(dealt.schema).parquet(given)
    for i in range(3):
        for source in (reconcile.LIVE, reconcile.BACKFILL):
            store.upsert(batches.where((F.col("from") == source) & (F.col("i") == i)).drop("from", "i"), source, i)
    return store.requests().select("request_id", "output_tokens", "source", "query_source", "cache_creation_5m_tokens")


@query(
    "reconcile_pass_summary",
    f"""WITH {ARRIVALS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival, source) AS k, min(arrival) FILTER (source = 'otel') OVER (PARTITION BY request_id) AS lf FROM arrivals),
a AS (SELECT *, CASE WHEN request_id IS NULL OR k = 1 THEN 'i' WHEN source = 'otel' AND arrival = lf THEN 't' WHEN source = 'backfill' AND cache_creation_5m_tokens IS NOT NULL THEN 'f' ELSE 'u' END AS act FROM r)
SELECT count(*) AS arrivals, count(*) FILTER (act = 'i') AS inserted, count(*) FILTER (act = 't') AS took_over, count(*) FILTER (act = 'f') AS filled, count(*) FILTER (act = 'u') AS unchanged,
  count(*) FILTER (model IS NULL AND event_type = 'api_request') AS unknown_model FROM a""",
)
def _(spark, d):
    return reconcile.pass_summary(reconcile.reconcile_actions(arrivals(spark, d)))


@query(
    "hook_sessions",
    """SELECT 'u-' || user_id AS session_id, arg_max(event_type, epoch_us(ts) // 1000) FILTER (event_type <> 'error') AS cwd, epoch_us(min(ts)) // 1000 AS first_seen_ms, epoch_us(max(ts)) // 1000 AS last_seen_ms, 'hook' AS source
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) GROUP BY user_id""",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "ts").agg(F.min_by("event_type", "event_id").alias("event_type"))
    # every event as a hook's payload, a folder only where the event is no error
    payload = F.to_json(F.struct(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("session_id"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("cwd"), F.lit("startup").alias("source")))
    starts = telemetry.parse_session_starts(e.select(payload.alias("payload"), F.timestamp_diff("MILLISECOND", F.expr(EPOCH), F.col("ts")).alias("seen_ms")))
    return reconcile.sessions_from_hooks(starts)


FOLDERS_SQL = f"""{RS}, f AS (SELECT session_id, CASE WHEN CAST(substr(request_id, 5) AS BIGINT) % 3 > 0 THEN '/work/' || model END AS cwd, CAST(substr(request_id, 5) AS BIGINT) AS pos FROM requests WHERE source = 'backfill'),
b AS (SELECT session_id, min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM requests WHERE session_id IS NOT NULL AND source = 'backfill' GROUP BY 1),
c AS (SELECT session_id, arg_min(cwd, pos) AS cwd FROM f WHERE cwd IS NOT NULL GROUP BY 1)"""


def _folders(spark, d):
    """Two transcript lines in three name a folder; ``pos`` is their place in the file."""
    n = F.substring("request_id", 5, 20).cast("bigint")
    return requests(spark, d).where("source = 'backfill'").select("session_id", F.when(n % 3 > 0, F.concat(F.lit("/work/"), "model")).alias("cwd"), n.alias("pos"))


@query("session_spans", f"{FOLDERS_SQL} SELECT session_id, cwd, lo AS first_seen_ms, hi AS last_seen_ms, 'backfill' AS source FROM b LEFT JOIN c USING (session_id)")
def _(spark, d):
    return reconcile.sessions_from_requests(requests(spark, d).where("source = 'backfill'"), _folders(spark, d))


@query(
    "backfill_summary",
    f"""{FOLDERS_SQL}, ARR, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY arrival, source) AS k, min(arrival) FILTER (source = 'otel') OVER (PARTITION BY request_id) AS lf FROM arrivals),
a AS (SELECT *, CASE WHEN request_id IS NULL OR k = 1 THEN 'i' WHEN source = 'otel' AND arrival = lf THEN 't' WHEN source = 'backfill' AND cache_creation_5m_tokens IS NOT NULL THEN 'f' ELSE 'u' END AS act FROM r),
after AS (SELECT coalesce(s.session_id, b.session_id) AS session_id, coalesce(s.cwd, c.cwd) AS cwd FROM sessions s FULL JOIN (b LEFT JOIN c USING (session_id)) ON s.session_id = b.session_id), {MESSAGES_SQL}
SELECT (SELECT count(DISTINCT session_id) FROM f) AS files, (SELECT count(*) FROM f) AS lines,
  (SELECT count(*) FROM a WHERE source = 'backfill') AS requests_seen, (SELECT count(*) FROM a WHERE source = 'backfill' AND act = 'i') AS requests_inserted,
  (SELECT count(*) FROM a WHERE source = 'backfill' AND act <> 'i') AS requests_deduped, (SELECT count(*) FROM a WHERE source = 'backfill' AND act = 'f') AS splits_filled,
  (SELECT count(*) FROM a WHERE source = 'backfill' AND act = 'i' AND cost_usd IS NULL) AS unpriced_inserted,
  (SELECT count(*) FROM after WHERE session_id NOT IN (SELECT session_id FROM sessions)) AS sessions_created,
  (SELECT count(*) FROM after JOIN sessions s USING (session_id) WHERE s.cwd IS NULL AND after.cwd IS NOT NULL) AS sessions_healed,
  (SELECT count(*) FROM messages WHERE role <> 'user') AS messages_inserted""".replace("ARR", ARRIVALS_SQL.removeprefix(REQUESTS_SQL).lstrip(",\n ")),
)
def _(spark, d):
    """A pass over all arrivals: the hooks' sessions and the users' messages were there before."""
    before, m = sessions(spark, d), messages(spark, d)
    backfilled = reconcile.sessions_from_requests(requests(spark, d).where("source = 'backfill'"), _folders(spark, d))
    files = _folders(spark, d).select(F.col("session_id").alias("file"))
    return reconcile.backfill_summary(files, reconcile.reconcile_actions(arrivals(spark, d)), (before, reconcile.merge_sessions(before, backfilled)), (m.where("role = 'user'"), m))


@query(
    "merged_sessions",
    f"""{RS}, b AS (SELECT session_id, min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM requests WHERE session_id IS NOT NULL AND source = 'backfill' GROUP BY 1)
SELECT coalesce(s.session_id, b.session_id) AS session_id, cwd, least(coalesce(first_seen_ms, lo), coalesce(lo, first_seen_ms)) AS first_seen_ms, greatest(coalesce(last_seen_ms, hi), coalesce(hi, last_seen_ms)) AS last_seen_ms,
  coalesce(s.source, 'backfill') AS source FROM sessions s FULL JOIN b ON s.session_id = b.session_id""",
)
def _(spark, d):
    backfilled = reconcile.sessions_from_requests(requests(spark, d).where("source = 'backfill'"))
    return reconcile.merge_sessions(sessions(spark, d), backfilled)


@query("merged_messages", f"WITH {MESSAGES_SQL} SELECT uuid, session_id, request_id, parent_uuid, role, timestamp_ms FROM messages")
def _(spark, d):
    m = messages(spark, d).drop("conv_id", "turn", "text")
    twice = m.withColumn("arrival", F.lit(1)).unionByName(m.withColumn("role", F.lit("late")).withColumn("arrival", F.lit(2)))
    return reconcile.merge_messages(twice).select("uuid", "session_id", "request_id", "parent_uuid", "role", "timestamp_ms")


DIFF_START = NOW_MS - 12 * DAY_MS
DIFF_TABLES = f"""WITH {ARRIVALS_SQL}, t AS (SELECT request_id, bool_or(timestamp_ms >= {DIFF_START}) AS t FROM arrivals WHERE source = 'backfill' AND timestamp_ms >= {DIFF_START - 600000} AND timestamp_ms < {NOW_MS} AND request_id IS NOT NULL GROUP BY 1),
o AS (SELECT request_id, bool_or(timestamp_ms >= {DIFF_START}) AS o FROM arrivals WHERE source = 'otel' AND event_type = 'api_request' AND timestamp_ms >= {DIFF_START - 600000} AND timestamp_ms < {NOW_MS} AND request_id IS NOT NULL GROUP BY 1),
c AS (SELECT CASE WHEN t AND o IS NOT NULL THEN 'm' WHEN t THEN 'b' WHEN o AND t IS NULL THEN 'o' END AS k FROM t FULL JOIN o USING (request_id))"""


@query(
    "capture_diff",
    f"{DIFF_TABLES} SELECT count(*) FILTER (k = 'm') AS matched, count(*) FILTER (k = 'b') AS backfill_only, count(*) FILTER (k = 'o') AS otel_only, count(*) FILTER (k IN ('m', 'b')) AS transcript, round(100.0 * count(*) FILTER (k = 'b') / nullif(count(*) FILTER (k IN ('m', 'b')), 0), 6) AS missing_pct FROM c",
)
def _(spark, d):
    a = arrivals(spark, d)
    return reconcile.capture_diff(a.where("source = 'backfill'"), a, DIFF_START, NOW_MS)


@query(
    "fuzzy_matches",
    f"""{RS}, late AS (SELECT * REPLACE ('late_' || request_id AS request_id, timestamp_ms + CAST(substr(request_id, 5) AS BIGINT) % 3000 AS timestamp_ms) FROM requests)
SELECT a.request_id AS left_id, b.request_id AS right_id, b.timestamp_ms - a.timestamp_ms AS apart_ms FROM requests a JOIN late b
ON a.session_id = b.session_id AND a.model = b.model AND a.input_tokens = b.input_tokens AND a.output_tokens = b.output_tokens AND abs(a.timestamp_ms - b.timestamp_ms) <= 2000 AND a.request_id <> b.request_id""",
)
def _(spark, d):
    r = requests(spark, d)
    n = F.substring("request_id", 5, 20).cast("bigint")
    late = r.withColumn("timestamp_ms", F.col("timestamp_ms") + n % 3000).withColumn("request_id", F.concat(F.lit("late_"), "request_id"))
    return reconcile.fuzzy_matches(r, late)


@query("nearest_matches")
def _(spark, d):
    """Each request and the late copy that is nearest to it, each in one match at most."""
    r = requests(spark, d).withColumnRenamed("request_id", "id")
    late = r.withColumn("timestamp_ms", F.col("timestamp_ms") + F.substring("id", 5, 20).cast("bigint") % 3000).withColumn("id", F.concat(F.lit("late_"), "id"))
    return reconcile.nearest_matches(r, late)


# Conversations

CHAT_SQL = f"{MESSAGES_SQL}, creq AS (SELECT session_id, request_id, timestamp_ms, length(text) / 1000 AS cost_usd FROM messages WHERE request_id IS NOT NULL)"


def _chat(spark, d):
    m = messages(spark, d)
    r = m.where("request_id is not null").select("session_id", "request_id", "timestamp_ms", (F.char_length("text") / 1000).alias("cost_usd"))
    return r, m


@query("session_transcript", f"WITH {CHAT_SQL} SELECT session_id, request_id, timestamp_ms, cost_usd, conv_id || ':' || turn AS uuids FROM creq JOIN (SELECT request_id, conv_id, turn FROM messages) USING (request_id)")
def _(spark, d):
    return transcripts.session_turns(*_chat(spark, d)).withColumn("uuids", F.array_join("uuids", ","))


@query(
    "request_transcripts",
    f"""WITH {CHAT_SQL}, n AS (SELECT a.request_id, b.uuid, b.turn, row_number() OVER (PARTITION BY a.request_id ORDER BY b.turn DESC) AS k FROM messages a JOIN messages b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.request_id IS NOT NULL)
SELECT request_id, CAST(count(*) FILTER (k <= 64) AS INTEGER) AS n_turns, count(*) <= 64 AS chain_complete, string_agg(uuid, ',' ORDER BY turn) FILTER (k <= 64) AS uuids FROM n GROUP BY 1""",
)
def _(spark, d):
    return transcripts.request_chains(*_chat(spark, d)).withColumn("uuids", F.array_join("uuids", ","))


@query("content_blocks", f"WITH {MESSAGES_SQL} SELECT uuid, CAST(0 AS INTEGER) AS at, 'text' AS kind, coalesce(text, '') AS text FROM messages")
def _(spark, d):
    return transcripts.content_blocks(messages(spark, d)).select("uuid", "at", "kind", "text")


def _transcript_lines(spark, d):
    """Every request as two transcript lines of a file for each session: a first chunk and the whole."""
    r = requests(spark, d, deal=True).withColumn("n", F.substring("request_id", 5, 20).cast("bigint"))
    chunk = F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk")
    usage = F.struct(
        F.col("input_tokens").cast("string").alias("input_tokens"),
        F.when(F.col("chunk") == 1, 1).otherwise(F.col("output_tokens")).alias("output_tokens"),
        F.col("cache_read_tokens").alias("cache_read_input_tokens"),
        F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
        F.when(F.col("cache_creation_5m_tokens").isNotNull(), F.struct(F.col("cache_creation_5m_tokens").alias("ephemeral_5m_input_tokens"), F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens"))).alias("cache_creation"),
    )
    line = F.to_json(
        F.struct(
            F.when(F.col("event_type") == "api_error", "system").otherwise("assistant").alias("type"),
            F.concat_ws(":", "request_id", F.col("chunk").cast("string")).alias("uuid"),
            F.col("request_id").alias("requestId"),
            F.col("session_id").alias("sessionId"),
            iso_ms(F.col("timestamp_ms")).alias("timestamp"),
            (F.col("query_source") == "subagent").alias("isSidechain"),
            F.struct("model", F.array(F.struct(F.lit("text").alias("type"), F.lit("…").alias("text"))).alias("content"), usage.alias("usage")).alias("message"),
        )
    )
    cut = F.when(F.col("n") % 89 == 0, F.substring(line, 1, 40)).otherwise(line)
    return r.select("*", chunk).select(F.coalesce("session_id", F.lit("none")).alias("file"), (F.col("n") * 2 + F.col("chunk")).alias("pos"), F.explode(F.array(cut)).alias("line"))


@query(
    "transcript_requests",
    f"""WITH {REQUESTS_SQL} SELECT request_id, session_id, timestamp_ms, model, CASE WHEN query_source = 'subagent' THEN 'subagent' END AS query_source, {TOKENS}, cache_creation_5m_tokens, cache_creation_1h_tokens
FROM requests WHERE event_type = 'api_request' AND session_id IS NOT NULL AND CAST(substr(request_id, 5) AS BIGINT) % 89 <> 0""",
)
def _(spark, d):
    collapsed = transcripts.collapse_requests(transcripts.extract_usage(transcripts.parse_lines(_transcript_lines(spark, d))))
    return transcripts.transcript_requests(collapsed).select("request_id", "session_id", "timestamp_ms", "model", "query_source", *TOKENS.split(", "), "cache_creation_5m_tokens", "cache_creation_1h_tokens")


@query(
    "transcript_stats",
    f"""WITH {REQUESTS_SQL}, r AS (SELECT *, CAST(substr(request_id, 5) AS BIGINT) % 89 = 0 AS cut, event_type = 'api_request' AS a FROM requests)
SELECT 2 * count(*) AS read, 2 * count(*) FILTER (NOT cut AND a) AS assistant, 2 * count(*) FILTER (NOT cut AND NOT a) AS skipped, 2 * count(*) FILTER (cut) AS malformed,
  2 * count(*) FILTER (NOT cut AND a AND session_id IS NULL) AS invalid, 2 * count(*) FILTER (NOT cut AND a AND session_id IS NOT NULL AND query_source = 'subagent') AS sidechain FROM r""",
)
def _(spark, d):
    return transcripts.parse_stats(transcripts.line_statuses(_transcript_lines(spark, d)))


@query("transcript_messages", f"WITH {REQUESTS_SQL} SELECT request_id || ':2' AS uuid, session_id, request_id, 'assistant' AS role, timestamp_ms FROM requests WHERE event_type = 'api_request' AND session_id IS NOT NULL AND CAST(substr(request_id, 5) AS BIGINT) % 89 <> 0")
def _(spark, d):
    found = transcripts.collapse_messages(transcripts.extract_messages(transcripts.parse_lines(_transcript_lines(spark, d))))
    return found.select("uuid", "session_id", "request_id", "role", "timestamp_ms")


def _otlp_bodies(spark, d):
    """The requests as export bodies of an hour and 2,000 rows at most each, numbers written in turn as numbers and as strings."""
    r = requests(spark, d).withColumn("n", F.substring("request_id", 5, 20).cast("bigint"))
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.to_json(F.struct(v.cast("string").alias("stringValue"))).alias("value"))
    whole = lambda k, v: F.struct(F.lit(k).alias("key"), F.when(F.col("n") % 2 == 0, F.to_json(F.struct(v.alias("intValue")))).otherwise(F.to_json(F.struct(v.cast("string").alias("intValue")))).alias("value"))
    real = lambda k, v: F.struct(F.lit(k).alias("key"), F.to_json(F.struct(v.alias("doubleValue"))).alias("value"))
    pairs = F.filter(
        F.array(
            text("session.id", F.col("session_id")), text("request_id", F.col("request_id")), text("model", F.col("model")), text("query_source", F.col("query_source")),
            text("user.email", F.lit("someone@example.com")), text("error", F.col("error")), real("cost_usd", F.col("cost_usd")), whole("input_tokens", F.col("input_tokens")), whole("output_tokens", F.col("output_tokens")),
            whole("cache_read_tokens", F.col("cache_read_tokens")), whole("cache_creation_tokens", F.col("cache_creation_tokens")),
        ),
        lambda a: a["value"] != "{}",
    )
    joined = F.array_join(F.transform(pairs, lambda a: F.concat(F.lit('{"key":"'), a["key"], F.lit('","value":'), a["value"], F.lit("}"))), ",")
    time = F.when(F.col("n") % 5 == 0, F.lit('"observedTimeUnixNano":"')).otherwise(F.lit('"timeUnixNano":"'))
    name = F.when(F.col("n") % 41 == 0, F.lit("user_prompt")).otherwise(F.col("event_type"))
    record = F.concat(F.lit("{"), time, (F.col("timestamp_ms") * 1_000_000 + 999_999).cast("string"), F.lit('","body":{"stringValue":"claude_code.'), name, F.lit('"},"attributes":['), joined, F.lit("]}"))
    hours = r.select(record.alias("record"), F.expr("timestamp_ms div 3600000").alias("hour"), F.expr("n div 2000").alias("block")).groupBy("hour", "block").agg(F.array_join(F.collect_list("record"), ",").alias("records"))
    return hours.select(F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":['), "records", F.lit("]}]}]}")).alias("body"))


@query(
    "otlp_requests",
    f"""WITH {REQUESTS_SQL} SELECT request_id, session_id, timestamp_ms, model, query_source, cost_usd, {TOKENS}, event_type, error,
CASE WHEN CAST(substr(request_id, 5) AS BIGINT) % 41 = 0 THEN 'skipped' WHEN session_id IS NULL THEN 'failed' ELSE 'ok' END AS status FROM requests WHERE CAST(substr(request_id, 5) AS BIGINT) % 41 <> 0""",
)
def _(spark, d):
    events = telemetry.parse_otlp_events(telemetry.log_records(_otlp_bodies(spark, d))).where("status != 'skipped'")
    return events.select("request_id", "session_id", "timestamp_ms", "model", "query_source", "cost_usd", *TOKENS.split(", "), "event_type", "error", "status")


@query(
    "otlp_last_failure",
    f"""WITH {REQUESTS_SQL} SELECT timestamp_ms, event_type || ' ' || request_id || ': no session' AS failure FROM requests
WHERE session_id IS NULL AND CAST(substr(request_id, 5) AS BIGINT) % 41 <> 0 ORDER BY timestamp_ms DESC, failure DESC LIMIT 1""",
)
def _(spark, d):
    return telemetry.last_failure(telemetry.parse_otlp_events(telemetry.log_records(_otlp_bodies(spark, d))))


@query(
    "otlp_ingest_metrics",
    f"""WITH {REQUESTS_SQL}, r AS (SELECT *, CAST(substr(request_id, 5) AS BIGINT) % 41 = 0 AS other FROM requests)
SELECT count(*) FILTER (NOT other AND session_id IS NOT NULL) AS ingested, count(*) FILTER (NOT other AND session_id IS NULL) AS failed, count(*) FILTER (other) AS skipped, max(timestamp_ms) FILTER (NOT other AND session_id IS NOT NULL) AS newest_ms FROM r""",
)
def _(spark, d):
    return telemetry.ingest_metrics(telemetry.parse_otlp_events(telemetry.log_records(_otlp_bodies(spark, d))))


# Calendar

@query("month_windows", f"WITH {REQUESTS_SQL} SELECT DISTINCT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m') AS month, epoch_ms(date_trunc('month', make_timestamp(timestamp_ms * 1000))) AS start_ms, epoch_ms(date_trunc('month', make_timestamp(timestamp_ms * 1000)) + INTERVAL 1 MONTH) AS end_ms FROM requests")
def _(spark, d):
    window = month_window(local_date("timestamp_ms", "UTC"), "UTC")
    return requests(spark, d).select(month_key("timestamp_ms", "UTC").alias("month"), window["start"].alias("start_ms"), window["end"].alias("end_ms")).distinct()


@query(
    "partial_days",
    f"""WITH {REQUESTS_SQL}, spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day), w AS (SELECT day, greatest(epoch_ms(day::TIMESTAMP), {NOW_MS - 5 * DAY_MS + 3600000}) AS s, least(epoch_ms(day::TIMESTAMP) + 86400000, {NOW_MS - 7200000}) AS e FROM spine)
SELECT day, s AS start, e AS "end", count(request_id) AS rows FROM w LEFT JOIN requests ON timestamp_ms >= s AND timestamp_ms < e WHERE s < e GROUP BY ALL""",
)
def _(spark, d):
    spine = trailing_days(spark, F.lit(TODAY).cast("date"), 7, "UTC")
    cut = clamped_days(spine, F.lit(NOW_MS - 5 * DAY_MS + 3_600_000), F.lit(NOW_MS - 7_200_000))
    r = requests(spark, d).select("request_id", "timestamp_ms", local_date("timestamp_ms", "UTC").alias("day"))
    inside = F.count_if((F.col("timestamp_ms") >= F.col("start")) & (F.col("timestamp_ms") < F.col("end")))
    return cut.join(r, "day", "left").groupBy("day", "start", "end").agg(inside.alias("rows"))


@query(
    "quiet_requests",
    f"WITH {REQUESTS_SQL}, m AS (SELECT *, hour(make_timestamp(timestamp_ms * 1000)) * 60 + minute(make_timestamp(timestamp_ms * 1000)) AS mins FROM requests) SELECT request_id, mins >= 1350 OR mins < 405 AS wrapped, mins >= 540 AND mins < 1020 AS daytime, false AS malformed FROM m",
)
def _(spark, d):
    ms = F.col("timestamp_ms")
    quiet = lambda a, b: is_quiet(ms, F.lit(a), F.lit(b), "UTC")
    return requests(spark, d).select("request_id", quiet("22:30", "06:45").alias("wrapped"), quiet("09:00", "17:00").alias("daytime"), quiet("9:00", "17:00").alias("malformed"))


@query("minutes_since_last", f"WITH {REQUESTS_SQL} SELECT session_id, ({NOW_MS} - max(timestamp_ms)) // 60000 AS minutes FROM requests GROUP BY 1")
def _(spark, d):
    last = requests(spark, d).groupBy("session_id").agg(F.max("timestamp_ms").alias("last_ms"))
    return last.select("session_id", minutes_between(F.col("last_ms"), F.lit(NOW_MS)).alias("minutes"))


# Budgets, alerts, health

BUDGETS = (("daily", MIDNIGHT, NOW_MS, 9000.0, True), ("monthly", MONTH_START, NOW_MS, 500000.0, True), ("week", MIDNIGHT - 6 * DAY_MS, NOW_MS, 100000.0, True), ("none", MIDNIGHT, NOW_MS, 0.0, True), ("off", MIDNIGHT, NOW_MS, 1.0, False))


def _budget_status(spark, d):
    table = spark.createDataFrame(list(BUDGETS), "name string, start bigint, `end` bigint, amount double, enabled boolean")
    return budgets.budget_status(requests(spark, d), table)


BUDGET_VALUES = ", ".join(f"('{n}', {s}, {e}, {a}::DOUBLE)" for n, s, e, a, on in BUDGETS if on)
BUDGET_SQL = f"""{RS}, b(name, s, e, amount) AS (VALUES {BUDGET_VALUES}),
x AS (SELECT name, amount, round(coalesce(sum(cost_usd), 0), 6) AS spent, count(*) FILTER (event_type = 'api_request' AND cost_usd IS NULL) AS unpriced FROM b LEFT JOIN requests ON timestamp_ms >= s AND timestamp_ms < e GROUP BY ALL),
y AS (SELECT *, CASE WHEN amount > 0 THEN CAST(round(100.0 * spent / amount) AS BIGINT) ELSE 0 END AS percent, spent >= amount AS exceeded FROM x)"""


@query("budget_status", f"{BUDGET_SQL} SELECT *, CASE WHEN percent <= 50 THEN 'green' WHEN percent <= 75 THEN 'yellow' WHEN percent <= 90 THEN 'amber' ELSE 'red' END AS band FROM y")
def _(spark, d):
    return _budget_status(spark, d)


IST_MS = 19_800_000
KOLKATA = [(f"day {k}", MIDNIGHT - k * DAY_MS - IST_MS, MIDNIGHT - (k - 1) * DAY_MS - IST_MS, a, True) for k, a in ((0, 0.25), (1, 5000.0), (2, 5000.0))]
KOLKATA += [("month", MONTH_START - IST_MS, NOW_MS - IST_MS, 500000.0, True), ("minutes", MIDNIGHT + 600_000, MIDNIGHT + 1_500_001, 50.0, True), ("hours", MIDNIGHT + 1_800_000, MIDNIGHT + 5_400_000, 50.0, True)]


@query(
    "budget_status_kolkata",
    BUDGET_SQL.replace(BUDGET_VALUES, ", ".join(f"('{n}', {s}, {e}, {max(a, 1.0)}::DOUBLE)" for n, s, e, a, _ in KOLKATA))
    + " SELECT *, CASE WHEN percent <= 50 THEN 'green' WHEN percent <= 75 THEN 'yellow' WHEN percent <= 90 THEN 'amber' ELSE 'red' END AS band FROM y",
)
def _(spark, d):
    """Days and the month of a zone whose midnight is no whole hour of UTC, and windows within hours."""
    table = spark.createDataFrame(KOLKATA, "name string, start bigint, `end` bigint, amount double, enabled boolean")
    return budgets.budget_status(requests(spark, d), budgets.checked_budgets(table))


@query("worst_budget_band", f"{BUDGET_SQL} SELECT CASE WHEN max(percent) <= 50 THEN 'green' WHEN max(percent) <= 75 THEN 'yellow' WHEN max(percent) <= 90 THEN 'amber' ELSE 'red' END AS band FROM y")
def _(spark, d):
    return budgets.worst_band(_budget_status(spark, d))


def _quota_windows(spark, d):
    """A snapshot for each day: the share of each kind of event in hundredths, as payloads."""
    r = requests(spark, d).groupBy(F.expr(f"timestamp_ms div {DAY_MS} * {DAY_MS}").alias("fetched_ms")).agg(
        *[F.count_if(F.col("model") == m).alias(m) for m in ("m-click", "m-view", "m-signup")], F.count("*").alias("n")
    )
    used = lambda m: F.round(200.0 * F.col(f"`{m}`") / F.col("n"), 3)
    payload = F.to_json(
        F.struct(
            F.struct(used("m-click").alias("utilization"), iso_ms(F.col("fetched_ms")).alias("resets_at")).alias("five_hour"),
            F.struct(used("m-view").alias("utilization"), F.expr("fetched_ms div 1000").alias("resets_at")).alias("seven_day"),
            F.struct(F.lit(None).cast("double").alias("utilization"), F.lit(None).cast("string").alias("resets_at")).alias("seven_day_opus"),
        )
    )
    return telemetry.parse_quota_snapshots(r.select("fetched_ms", payload.alias("payload")))


QUOTA_SQL = f"""WITH {REQUESTS_SQL}, q AS (SELECT timestamp_ms // {DAY_MS} * {DAY_MS} AS fetched_ms, count(*) FILTER (model = 'm-click') AS c, count(*) FILTER (model = 'm-view') AS v, count(*) AS n FROM requests GROUP BY 1),
w AS (SELECT fetched_ms, 'five_hour' AS "window", round(200.0 * c / n, 3) AS utilization, fetched_ms AS resets_at_ms FROM q UNION ALL SELECT fetched_ms, 'seven_day', round(200.0 * v / n, 3), fetched_ms FROM q)"""


@query("quota_status", f'{QUOTA_SQL} SELECT fetched_ms, arg_max("window", (utilization, "window")) AS most_used, max(utilization) AS utilization, coalesce(bool_or(utilization > 40), false) AS near_limit FROM w GROUP BY 1')
def _(spark, d):
    return budgets.quota_status(_quota_windows(spark, d), 40.0)


@query("latest_quota_snapshot", f"""{QUOTA_SQL} SELECT fetched_ms, "window", utilization, resets_at_ms FROM w WHERE fetched_ms = (SELECT max(fetched_ms) FROM w) UNION ALL SELECT max(fetched_ms), 'seven_day_opus', NULL, NULL FROM w""")
def _(spark, d):
    return budgets.latest_snapshot(_quota_windows(spark, d))


@query("quota_bands", f"""{QUOTA_SQL} SELECT fetched_ms, "window", CASE WHEN utilization > 90 THEN 'danger' WHEN utilization >= 75 THEN 'warning' WHEN utilization IS NOT NULL THEN 'ok' ELSE 'unknown' END AS band,
CASE WHEN resets_at_ms > {MIDNIGHT - 5 * DAY_MS} THEN (resets_at_ms - {MIDNIGHT - 5 * DAY_MS}) // 60000 END AS minutes_left
FROM (SELECT fetched_ms, "window", utilization, resets_at_ms FROM w UNION ALL SELECT fetched_ms, 'seven_day_opus', NULL, NULL FROM q)""")
def _(spark, d):
    timed = budgets.with_reset_times(_quota_windows(spark, d), F.lit(MIDNIGHT - 5 * DAY_MS))
    return timed.select("fetched_ms", "window", budgets.usage_band(F.col("utilization")).alias("band"), "minutes_left")


@query("silent_gaps", f"WITH {REQUESTS_SQL}, g AS (SELECT timestamp_ms, lag(timestamp_ms) OVER (ORDER BY timestamp_ms) AS p FROM requests WHERE source = 'otel') SELECT p AS from_ms, timestamp_ms AS to_ms, (timestamp_ms - p) // 60000 AS minutes FROM g WHERE timestamp_ms - p >= 600000")
def _(spark, d):
    return budgets.silent_gaps(requests(spark, d), 10)


ROLLING_SQL = f"""WITH {REQUESTS_SQL}, m AS (SELECT model, timestamp_ms // 60000 AS minute, sum(cost_usd) AS cost FROM requests WHERE cost_usd IS NOT NULL GROUP BY 1, 2),
roll AS (SELECT model, minute, round(sum(cost) OVER (PARTITION BY model ORDER BY minute RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS spend FROM m)"""


@query("rolling_spend", f"{ROLLING_SQL} SELECT * FROM roll")
def _(spark, d):
    return alerts.rolling_spend(requests(spark, d), 30)


@query("month_to_date", f"WITH {REQUESTS_SQL}, d AS (SELECT {DAY} AS day, coalesce(sum(cost_usd), 0) AS cost FROM requests GROUP BY 1), s AS (SELECT day, round(sum(cost) OVER (PARTITION BY date_trunc('month', day) ORDER BY day), 6) AS spend FROM d) SELECT day, spend, CASE WHEN spend > 0 THEN CAST(floor(spend / 5000) AS BIGINT) ELSE 0 END AS steps FROM s")
def _(spark, d):
    return rollups.month_to_date(requests(spark, d), 5000.0)


@query(
    "milestone_alerts",
    f"""WITH {REQUESTS_SQL}, c AS (SELECT {DAY} AS day, timestamp_ms // 5000 AS cell, coalesce(sum(cost_usd), 0) AS cost, max(timestamp_ms) AS timestamp_ms FROM requests GROUP BY 1, 2),
r AS (SELECT *, round(sum(cost) OVER (PARTITION BY date_trunc('month', day) ORDER BY cell), 6) AS spend FROM c), s AS (SELECT *, CAST(floor(spend / 5000) AS BIGINT) AS steps FROM r),
t AS (SELECT *, coalesce(lag(steps) OVER (PARTITION BY date_trunc('month', day) ORDER BY cell), 0) AS was FROM s)
SELECT timestamp_ms, steps, spend, strftime(day, '%Y-%m') AS month FROM t WHERE steps > was""",
)
def _(spark, d):
    return alerts.milestone_alerts(requests(spark, d), 5000.0)


@query(
    "burst_alerts",
    ROLLING_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + """, x AS (SELECT model, minute, spend FROM roll WHERE spend >= 250), fired AS (
  SELECT model, min(minute) AS minute FROM x GROUP BY model
  UNION ALL
  SELECT f.model, (SELECT min(minute) FROM x WHERE x.model = f.model AND x.minute >= f.minute + 15) FROM fired f WHERE EXISTS (SELECT 1 FROM x WHERE x.model = f.model AND x.minute >= f.minute + 15)
) SELECT model, minute, spend FROM fired JOIN x USING (model, minute)""",
)
def _(spark, d):
    return alerts.burst_alerts(requests(spark, d), alerts.BurstRule(250.0, 30, 15))


@query("spend_before_requests", f"WITH {REQUESTS_SQL} SELECT DISTINCT model, timestamp_ms AS now_ms, round(coalesce(sum(cost_usd) OVER (PARTITION BY model ORDER BY timestamp_ms RANGE BETWEEN 1800000 PRECEDING AND 1 PRECEDING), 0), 6) AS spend FROM requests")
def _(spark, d):
    """What each model spent in the half hour before each of its requests, the request itself left out."""
    r = requests(spark, d)
    return alerts.spend_before(r, r.select("model", F.col("timestamp_ms").alias("now_ms")), 1_800_000)


@query(
    "burst_alerts_by_second",
    f"""WITH RECURSIVE {REQUESTS_SQL}, t AS (SELECT model, (timestamp_ms // 1000 + 1) * 1000 AS now_ms, sum(cost_usd) AS cost FROM requests WHERE cost_usd IS NOT NULL GROUP BY 1, 2),
x AS (SELECT * FROM (SELECT model, now_ms, round(sum(cost) OVER (PARTITION BY model ORDER BY now_ms RANGE BETWEEN 1799000 PRECEDING AND CURRENT ROW), 6) AS spend FROM t) WHERE spend >= 250), fired AS (
  SELECT model, min(now_ms) AS now_ms FROM x GROUP BY model
  UNION ALL
  SELECT f.model, (SELECT min(now_ms) FROM x WHERE x.model = f.model AND x.now_ms >= f.now_ms + 900000) FROM fired f WHERE EXISTS (SELECT 1 FROM x WHERE x.model = f.model AND x.now_ms >= f.now_ms + 900000)
) SELECT model, now_ms, spend FROM fired JOIN x USING (model, now_ms)""",
)
def _(spark, d):
    return alerts.bursts(requests(spark, d), alerts.BurstRule(250.0, 30, 15), tick_ms=1000)


@query("above_alert_floor", f"WITH {REQUESTS_SQL} SELECT request_id FROM requests WHERE timestamp_ms >= {NOW_MS - 6 * 3600000}")
def _(spark, d):
    return alerts.above_floor(requests(spark, d), NOW_MS, DAY_MS, NOW_MS - 6 * 3_600_000).select("request_id")


@query(
    "export_requests",
    f"""{RS} SELECT timestamp_ms, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(timestamp_ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS timestamp, model, query_source, cost_usd, {TOKENS}, cache_creation_5m_tokens, cache_creation_1h_tokens, event_type,
  error[:500] AS error, session_id, replace(cwd, '/home/dev/', '~/') AS project FROM requests LEFT JOIN (SELECT session_id, cwd FROM sessions) USING (session_id)""",
)
def _(spark, d):
    return exports.export_rows(requests(spark, d), sessions(spark, d), "/home/dev")
