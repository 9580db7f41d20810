"""Rollups over requests and sessions.

Requests are grouped by session before they meet the session table: the join then has a row for each
session, however many requests share one or have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import day_spine, local_date
from .measures import SPLIT, TOKENS, hit_rate, measures, money, summed, total_tokens

MOST_SERIES_DAYS = 1830
MOST_DAILY_DAYS = 366
DEFAULT_PAGE, MOST_PAGE, MOST_TIMELINE = 200, 2000, 1000


def usage_summary(requests: DataFrame) -> DataFrame:
    """One row: all measures, and the number of distinct sessions."""
    return requests.agg(*measures(), F.countDistinct("session_id").alias("sessions")).withColumn("cost_usd", money(F.col("cost_usd")))


def with_project(requests: DataFrame, sessions: DataFrame, *keys: str) -> DataFrame:
    """Partial measures by keys and session, with the session's working folder."""
    partial = requests.groupBy(*keys, "session_id").agg(*measures())
    return partial.join(sessions.select("session_id", "cwd"), "session_id", "left")


def project_rollups(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Measures and sessions by working folder, the unknown project being null; dearest first."""
    grouped = with_project(requests, sessions).groupBy("cwd").agg(*summed(), F.count("session_id").alias("sessions"))
    return grouped.withColumn("cost_usd", money(F.col("cost_usd"))).orderBy(F.desc("cost_usd"), F.asc_nulls_first("cwd"))


def _by_session(requests: DataFrame) -> DataFrame:
    # by model first: rows are then summed in hash tables of plain values, and only sums meet the collected models
    by_model = requests.where("session_id is not null").groupBy("session_id", "model").agg(
        F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"), *measures()
    )
    grouped = by_model.groupBy("session_id").agg(
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        *summed(),
        F.array_sort(F.collect_set("model")).alias("models"),
    )
    return grouped.withColumn("cost_usd", money(F.col("cost_usd"))).withColumn("total_tokens", total_tokens()).withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))


def session_rollups(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Measures, span, models and folder of each session; rows without a session are left out."""
    return _by_session(requests).join(sessions.select("session_id", "cwd"), "session_id", "left")


SESSION_ORDERS = {"cost": "cost_usd", "tokens": "total_tokens", "duration": "duration_ms", "start": "first_ms"}


def sorted_sessions(rollups: DataFrame, by: str = "cost", descending: bool = True) -> DataFrame:
    """Sorted by one measure, ties by session."""
    column = SESSION_ORDERS[by]
    return rollups.orderBy(F.desc(column) if descending else F.asc_nulls_first(column), "session_id")


def page(ordered: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """A page of 1 to 2000 rows: the page is the feature."""
    return ordered.offset(max(offset, 0)).limit(min(max(limit, 1), MOST_PAGE))


def session_page(requests: DataFrame, sessions: DataFrame, by: str = "cost", descending: bool = True, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """A page of the sorted rollups.

    Sessions meet their folders before they are ranked: a page that is joined afterwards has to be
    sorted again, and adaptive execution was seen to leave that sort out.
    """
    return page(sorted_sessions(session_rollups(requests, sessions), by, descending), limit, offset)


def session_models(requests: DataFrame, session_id: str) -> DataFrame:
    """The models of one session, the null model included; dearest first."""
    mix = requests.where(F.col("session_id") == session_id).groupBy("model").agg(*measures())
    return mix.withColumn("cost_usd", money(F.col("cost_usd"))).orderBy(F.desc("cost_usd"), F.asc_nulls_first("model"))


def model_mix(requests: DataFrame) -> DataFrame:
    """The models of every session."""
    mix = requests.where("session_id is not null").groupBy("session_id", "model").agg(*measures())
    return mix.withColumn("cost_usd", money(F.col("cost_usd")))


def session_timeline(requests: DataFrame, session_id: str, limit: int = MOST_TIMELINE) -> DataFrame:
    """The first rows of one session in order of time, and how many there are in all."""
    own = requests.where(F.col("session_id") == session_id)
    total = own.agg(F.count("*").alias("total_rows"))
    return own.orderBy("timestamp_ms", "request_id").limit(limit).crossJoin(F.broadcast(total))  # one row


def session_folder(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id).select("session_id", "cwd")


def usage_series(requests: DataFrame, zone: str = "UTC", start: int | None = None, end: int | None = None, most: int | None = MOST_SERIES_DAYS) -> DataFrame:
    """Measures of each local day, days without rows included; the last ``most`` days (1830) if not None.

    The series runs over the window, or from the oldest to the newest row. Rows are read once: each day
    that has some fills the days up to the next one.
    """
    days = requests.groupBy(local_date("timestamp_ms", zone).alias("day")).agg(*measures())
    first = local_date(F.lit(start).cast("bigint"), zone) if start is not None else None
    last = local_date(F.lit(end - 1).cast("bigint"), zone) if end is not None else None
    order = Window.orderBy("day")  # a row for each day
    newest = F.max("day").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begin = F.when(F.lag("day").over(order).isNull(), F.least("day", first)).otherwise(F.col("day")) if first is not None else F.col("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.greatest("day", last) if last is not None else F.col("day"))
    marked = days.select("*", begin.alias("begin"), until.alias("until"), (newest if last is None else last).alias("last"))
    whole = [c for c in days.columns if c not in ("day", *SPLIT)]
    own = F.col("at") == F.col("day")
    filled = marked.select("*", F.explode(F.sequence("begin", "until")).alias("at")).where(F.col("at") <= F.col("last"))
    if first is not None:
        filled = filled.where(F.col("at") >= first)
    if most is not None:
        filled = filled.where(F.col("at") > F.date_sub("last", most))
    columns = [F.when(own, F.col(c)).otherwise(F.lit(0)).alias(c) for c in whole] + [F.when(own, F.col(c)).alias(c) for c in SPLIT]
    return filled.select(F.col("at").alias("day"), *columns).withColumn("cost_usd", money(F.col("cost_usd"))).orderBy("day")


def usage_series_by_model(requests: DataFrame, zone: str = "UTC") -> DataFrame:
    """Measures by local day and model, where there are any; the null model is kept."""
    grouped = requests.groupBy(local_date("timestamp_ms", zone).alias("day"), "model").agg(*measures())
    return grouped.withColumn("cost_usd", money(F.col("cost_usd"))).orderBy("day", F.asc_nulls_first("model"))


def usage_series_by_project(requests: DataFrame, sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Measures by local day and working folder, in two stages."""
    dated = requests.withColumn("day", local_date("timestamp_ms", zone))
    grouped = with_project(dated, sessions, "day").groupBy("day", "cwd").agg(*summed())
    return grouped.withColumn("cost_usd", money(F.col("cost_usd"))).orderBy("day", F.asc_nulls_first("cwd"))


def daily_costs(requests: DataFrame, last: Column, n: int, zone: str = "UTC") -> DataFrame:
    """Cost and requests of each of the ``n`` days (1 to 366) up to ``last``, zeros included."""
    n = min(max(n, 1), MOST_DAILY_DAYS)
    spine = day_spine(requests.sparkSession, F.date_sub(last, n - 1), last, zone).select("day")
    grouped = requests.groupBy(local_date("timestamp_ms", zone).alias("day")).agg(*measures()).select("day", "cost_usd", "requests")
    filled = spine.join(grouped, "day", "left")
    return filled.select("day", money(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"), F.coalesce("requests", F.lit(0)).alias("requests")).orderBy("day")


def top_projects(requests: DataFrame, sessions: DataFrame, n: int = 3) -> DataFrame:
    """The dearest projects by requests alone; ties by name."""
    only = requests.where("event_type = 'api_request'")
    return project_rollups(only, sessions).select("cwd", "cost_usd").limit(n)


def priced_spend(requests: DataFrame, floor: int | None = None) -> DataFrame:
    """The sum of known costs since ``floor``, and how many requests have none."""
    rows = requests if floor is None else requests.where(F.col("timestamp_ms") >= floor)
    return rows.agg(
        money(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("spend"),
        F.count_if((F.col("event_type") == "api_request") & F.col("cost_usd").isNull()).alias("unpriced"),
    )


def window_cost(requests: DataFrame) -> DataFrame:
    return requests.agg(money(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("cost_usd"))


def live_capture_stats(requests: DataFrame, clock_ms: int) -> DataFrame:
    """Live rows, the newest of them, and the freshest of that and the stream's own clock."""
    live = requests.where("source = 'otel'").agg(F.count("*").alias("live_rows"), F.max("timestamp_ms").alias("newest_ms"))
    return live.withColumn("freshest_ms", F.greatest("newest_ms", F.lit(clock_ms)))


def facet_options(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(kind, value): distinct projects and models, and a row for the unknown project if there is one.

    A request whose session is not in the session table does not make one.
    """
    projects = sessions.where("cwd is not null").select(F.lit("project").alias("kind"), F.col("cwd").alias("value")).distinct()
    models = requests.where("model is not null").select(F.lit("model").alias("kind"), F.col("model").alias("value")).distinct()
    flags = (
        sessions.where("cwd is null").select(F.lit("unknown").alias("kind")).limit(1)
        .unionByName(requests.where("session_id is null").select(F.lit("unknown").alias("kind")).limit(1))
        .distinct()
        .withColumn("value", F.lit(None).cast("string"))
    )
    return projects.unionByName(models).unionByName(flags).orderBy("kind", "value")


def series_anchor(requests: DataFrame, zone: str = "UTC") -> DataFrame:
    """The day at which a series over everything starts; no row without requests."""
    oldest = requests.agg(F.min("timestamp_ms").alias("ms")).where("ms is not null")
    return oldest.select(local_date("ms", zone).alias("day"))


def cache_hits(requests: DataFrame, *keys: Column) -> DataFrame:
    """The cache's hit rate by keys."""
    grouped = requests.groupBy(*keys).agg(*measures())
    return grouped.withColumn("hit_rate", F.round(hit_rate(), 9))


def cache_split(series: DataFrame) -> DataFrame:
    """Cache writes of each day by life: five minutes, an hour, or not known."""
    five, hour = F.coalesce(SPLIT[0], F.lit(0)), F.coalesce(SPLIT[1], F.lit(0))
    rest = F.greatest(F.col(TOKENS[3]) - five - hour, F.lit(0))
    return series.select("day", five.alias("tokens_5m"), hour.alias("tokens_1h"), rest.alias("unsplit"))


def cost_share(rollups: DataFrame, key: str) -> DataFrame:
    """Each row's share of all cost, null unless that is positive."""
    whole = rollups.agg(F.sum("cost_usd").alias("whole"))
    share = F.when(F.col("whole") > 0, F.round(F.col("cost_usd") / F.col("whole"), 9))
    return rollups.crossJoin(F.broadcast(whole)).select(key, "cost_usd", share.alias("share"))  # one row


def top_keys_by_day(requests: DataFrame, key: str, n: int = 8, zone: str = "UTC") -> DataFrame:
    """Cost by day of the ``n`` dearest keys over the range; all others together are ``Other``."""
    daily = requests.groupBy(local_date("timestamp_ms", zone).alias("day"), key).agg(F.sum("cost_usd").alias("cost"))
    totals = daily.groupBy(key).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("whole"))
    top = totals.orderBy(F.desc("whole"), F.asc_nulls_first(key)).limit(n).withColumn("top", F.lit(True)).drop("whole").withColumnRenamed(key, "top_key")
    named = daily.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("top_key")), "left")  # n rows
    label = F.when(F.col("top"), F.coalesce(key, F.lit("(none)"))).otherwise("Other")
    return named.groupBy("day", label.alias("label")).agg(money(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost_usd")).orderBy("day", "label")


def peak_day(series: DataFrame) -> DataFrame:
    """The day of the largest cost, the earlier of equal ones."""
    return series.orderBy(F.desc("cost_usd"), "day").limit(1).select("day", "cost_usd")


def reconcile_check(requests: DataFrame, sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """One row: whether summary, series, groups, sessions and projects add up to the same."""

    def sums(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum(total_tokens()).alias("tokens")).withColumn("view", F.lit(name))

    sessionless = requests.where("session_id is null").agg(*measures())
    shared = ["requests", "errors", *TOKENS]
    views = [
        sums(usage_summary(requests), "summary"),
        sums(usage_series(requests, zone, most=None), "series"),
        sums(usage_series_by_model(requests, zone), "by model"),
        sums(usage_series_by_project(requests, sessions, zone), "by project"),
        sums(session_rollups(requests, sessions).select(*shared).unionByName(sessionless.select(*shared)), "sessions"),
        sums(project_rollups(requests, sessions), "projects"),
    ]
    every = views[0]
    for more in views[1:]:
        every = every.unionByName(more)
    return every.agg(
        F.count("*").alias("views"),
        *[(F.min(c) == F.max(c)).alias(f"{c}_agree") for c in ("requests", "errors", "tokens")],
        *[F.max(c).alias(c) for c in ("requests", "errors", "tokens")],
    )


def month_to_date(requests: DataFrame, step: float, zone: str = "UTC") -> DataFrame:
    """Spend of each local month up to each day, and how many steps it has passed; 0 if either is not positive."""
    daily = requests.groupBy(local_date("timestamp_ms", zone).alias("day")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"))
    order = Window.partitionBy(F.trunc("day", "MM")).orderBy("day")
    spent = money(F.sum("cost").over(order))
    steps = F.when((F.col("spend") > 0) & (F.lit(step) > 0), F.floor(F.col("spend") / F.lit(step))).otherwise(F.lit(0))
    return daily.withColumn("spend", spent).select("day", "spend", steps.cast("bigint").alias("steps"))
