"""One table of requests, sessions and messages from live telemetry and from transcripts.

The result does not depend on the order of arrival of the two sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.files import work_folder

LIVE, BACKFILL = "otel", "backfill"
NEAR_MS = 600_000
FILLED = ("cache_creation_5m_tokens", "cache_creation_1h_tokens")


def fold_arrivals(arrivals: DataFrame) -> DataFrame:
    """The state of each request: (request_id, live, live_at, old, old_at), the first live row and the first backfilled one with their arrivals.

    A row without an id is a state of its own.
    """
    columns = [c for c in arrivals.columns if c != "arrival"]
    of = lambda source, value: F.when(F.col("source") == source, value)
    sides = {"live": of(LIVE, F.struct(*columns)), "live_at": of(LIVE, F.col("arrival")), "old": of(BACKFILL, F.struct(*columns)), "old_at": of(BACKFILL, F.col("arrival"))}
    return merge_states(arrivals.select("request_id", *[value.alias(name) for name, value in sides.items()]))


def merge_states(states: DataFrame) -> DataFrame:
    """One state for each id from several; the result does not depend on their order or on how they were merged before."""
    firsts = [x for side in ("live", "old") for x in (F.min_by(side, f"{side}_at").alias(side), F.min(f"{side}_at").alias(f"{side}_at"))]
    return states.where("request_id is not null").groupBy("request_id").agg(*firsts).unionByName(states.where("request_id is null"))


def requests_of(states: DataFrame) -> DataFrame:
    """The requests of states: the live row, with what only the backfilled one has, or else that one."""

    def pick(name: str) -> Column:
        if name in FILLED or name == "query_source":
            return F.coalesce(F.col("live")[name], F.col("old")[name])
        return F.when(F.col("live").isNotNull(), F.col("live")[name]).otherwise(F.col("old")[name])

    return states.select(*[pick(f.name).alias(f.name) for f in states.schema["live"].dataType])


def reconcile_requests(arrivals: DataFrame) -> DataFrame:
    """One row for each request id; rows without an id all stay.

    ``arrivals`` has the columns of requests and ``arrival``, a number that orders rows of one
    source. The first live row wins; the first backfilled row gives the 5m/1h split and a missing
    query source, and the whole row where nothing is live.
    """
    return requests_of(fold_arrivals(arrivals))


def reconcile_actions(arrivals: DataFrame) -> DataFrame:
    """What each arrival did: inserted, took over a backfilled row, filled fields in, or changed nothing.

    Rows without an id, which are all inserted, stay out of the windows.
    """
    order = Window.partitionBy("request_id").orderBy("arrival", "source")
    live_first = F.min(F.when(F.col("source") == LIVE, F.col("arrival"))).over(Window.partitionBy("request_id"))
    ranked = arrivals.where("request_id is not null").withColumn("k", F.row_number().over(order)).withColumn("live_first", live_first)
    action = (
        F.when(F.col("k") == 1, "inserted")
        .when((F.col("source") == LIVE) & (F.col("arrival") == F.col("live_first")), "took over")
        .when((F.col("source") == BACKFILL) & F.col("cache_creation_5m_tokens").isNotNull(), "filled")
        .otherwise("unchanged")
    )
    known = ranked.withColumn("action", action).drop("k", "live_first")
    return known.unionByName(arrivals.where("request_id is null").withColumn("action", F.lit("inserted")))


def pass_summary(actions: DataFrame) -> DataFrame:
    """One row: how many arrivals did what."""
    return actions.agg(
        F.count("*").alias("arrivals"),
        *[F.count_if(F.col("action") == a).alias(a.replace(" ", "_")) for a in ("inserted", "took over", "filled", "unchanged")],
        F.count_if(F.col("model").isNull() & (F.col("event_type") == "api_request")).alias("unknown_model"),
    )


def backfill_summary(
    files: DataFrame, actions: DataFrame, sessions: tuple[DataFrame, DataFrame], messages: tuple[DataFrame, DataFrame]
) -> DataFrame:
    """One row on a pass: files and lines read, what happened to its requests, and what it changed in sessions and messages.

    ``files`` has a row (file) for each line read, ``actions`` is of ``reconcile_actions``; sessions and
    messages are given as they were before and are after the pass. A session is healed where its
    folder was missing.
    """
    read = files.agg(F.countDistinct("file").alias("files"), F.count("*").alias("lines"))
    done = actions.where(F.col("source") == BACKFILL).agg(
        F.count("*").alias("requests_seen"),
        F.count_if(F.col("action") == "inserted").alias("requests_inserted"),
        F.count_if(F.col("action") != "inserted").alias("requests_deduped"),
        F.count_if(F.col("action") == "filled").alias("splits_filled"),
        F.count_if((F.col("action") == "inserted") & F.col("cost_usd").isNull()).alias("unpriced_inserted"),
    )
    old, new = (x.select("session_id", F.col("cwd").alias(name), F.lit(True).alias(f"has_{name}")) for x, name in zip(sessions, ("old", "new"), strict=True))
    changed = new.join(old, "session_id", "left").agg(
        F.count_if(F.col("has_old").isNull()).alias("sessions_created"),
        F.count_if(F.col("has_old") & F.col("old").isNull() & F.col("new").isNotNull()).alias("sessions_healed"),
    )
    added = messages[1].select("uuid").join(messages[0].select("uuid"), "uuid", "left_anti").agg(F.count("*").alias("messages_inserted"))
    return read.crossJoin(done).crossJoin(changed).crossJoin(added)  # of one row each


def sessions_from_hooks(sightings: DataFrame) -> DataFrame:
    """(session_id, cwd, seen_ms) folded by time: the last folder that was named, first and last sight."""
    return sightings.groupBy("session_id").agg(
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seen_ms"))).alias("cwd"),
        F.min("seen_ms").alias("first_seen_ms"),
        F.max("seen_ms").alias("last_seen_ms"),
    ).withColumn("source", F.lit("hook"))


def sessions_from_requests(requests: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Spans of sessions in transcripts, with a folder where ``folders`` (session_id, cwd, pos) has one."""
    spans = requests.where("session_id is not null").groupBy("session_id").agg(
        F.min("timestamp_ms").alias("first_seen_ms"), F.max("timestamp_ms").alias("last_seen_ms")
    )
    if folders is None:
        spans = spans.withColumn("cwd", F.lit(None).cast("string"))
    else:
        first = folders.where("cwd is not null").groupBy("session_id").agg(F.min_by("cwd", "pos").alias("cwd"))
        spans = spans.join(first, "session_id", "left")
    return spans.withColumn("source", F.lit(BACKFILL)).select("session_id", "cwd", "first_seen_ms", "last_seen_ms", "source")


def merge_sessions(hooks: DataFrame, backfilled: DataFrame) -> DataFrame:
    """Hooks keep their folder and source; backfill fills what is missing and widens the span."""
    h, b = hooks.alias("h"), backfilled.alias("b")
    return h.join(b, F.col("h.session_id") == F.col("b.session_id"), "full").select(
        F.coalesce("h.session_id", "b.session_id").alias("session_id"),
        F.coalesce("h.cwd", "b.cwd").alias("cwd"),
        F.least("h.first_seen_ms", "b.first_seen_ms").alias("first_seen_ms"),
        F.greatest("h.last_seen_ms", "b.last_seen_ms").alias("last_seen_ms"),
        F.coalesce("h.source", "b.source").alias("source"),
    )


def merge_messages(messages: DataFrame) -> DataFrame:
    """The first arrival of each message; ``messages`` has a column ``arrival``."""
    columns = [c for c in messages.columns if c != "arrival"]
    first = messages.groupBy("uuid").agg(F.min_by(F.struct(*columns), "arrival").alias("m"))
    return first.select("m.*")


def capture_classes(transcripts: DataFrame, live: DataFrame, start: int, end: int) -> DataFrame:
    """(request_id, class): matched, backfill_only or otel_only over the window [start, end).

    Rows up to ten minutes before the window count as known on their side, but not themselves.
    """
    inside = (F.col("timestamp_ms") >= start) & (F.col("timestamp_ms") < end)
    near = (F.col("timestamp_ms") >= start - NEAR_MS) & (F.col("timestamp_ms") < end)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col("request_id").isNotNull() & near).groupBy("request_id").agg(F.max(inside).alias(name))

    only_live = live.where((F.col("source") == LIVE) & (F.col("event_type") == "api_request"))
    both = side(transcripts, "t").join(side(only_live, "o"), "request_id", "full")
    kind = (
        F.when(F.col("t") & F.col("o").isNotNull(), "matched")
        .when(F.col("t"), "backfill_only")
        .when(F.col("o") & F.col("t").isNull(), "otel_only")
    )
    return both.select("request_id", kind.alias("class")).where("class is not null")


def capture_diff(transcripts: DataFrame, live: DataFrame, start: int, end: int) -> DataFrame:
    """One row: the classes' sizes, and the hundredths of the transcripts' requests that live capture missed."""
    counts = capture_classes(transcripts, live, start, end).agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in ("matched", "backfill_only", "otel_only")]
    )
    truth = F.col("matched") + F.col("backfill_only")
    return counts.withColumn("transcript", truth).withColumn("missing_pct", F.round(F.try_divide(100.0 * F.col("backfill_only"), truth), 6))


def fuzzy_matches(left: DataFrame, right: DataFrame, within_ms: int = 2000) -> DataFrame:
    """Pairs of rows without a common id: equal session, model and tokens, and at most ``within_ms`` apart.

    The left rows are dealt to their time cell and both neighbours, so the join has equal keys only.
    """
    keys = ["session_id", "model", "input_tokens", "output_tokens"]
    cell = F.floor(F.col("timestamp_ms") / within_ms)
    l_rows = left.select(F.col("request_id").alias("left_id"), F.col("timestamp_ms").alias("left_ms"), *keys, F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    r_rows = right.select(F.col("request_id").alias("right_id"), F.col("timestamp_ms").alias("right_ms"), *keys, cell.alias("cell"))
    near = F.abs(F.col("left_ms") - F.col("right_ms")) <= within_ms
    return l_rows.join(r_rows, [*keys, "cell"]).where(near & (F.col("left_id") != F.col("right_id"))).select("left_id", "right_id", (F.col("right_ms") - F.col("left_ms")).alias("apart_ms"))


SIGNATURE = ("session_id", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
SALTS = 64


def nearest_matches(left: DataFrame, right: DataFrame, within_ms: int = 2000, keys: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """(left_id, right_id, apart_ms): rows of equal ``keys`` at most ``within_ms`` apart, each row in one match at most.

    Nearest rows first: of all pairs that are left, the one of the smallest distance, and of equal ones the
    earliest, is matched next, until no pair is near enough. ``left`` and ``right`` have ``id`` and
    ``timestamp_ms``. A null key or time matches nothing; rows that are equal in keys and time are matched in
    order of a hash of their id, so n of each side give n matches.

    No pairs are made. Rows are counted by keys and millisecond; each round matches the neighbours that are
    nearest to each other, all at once, with as many rows as the fewer of them has. Rounds are few, as
    each removes one side of every mutual pair; each is written.
    """
    spark = left.sparkSession
    folder, given, keys = work_folder(spark, "nearest"), keys, [f"key{i}" for i in range(len(keys))]

    def side(rows: DataFrame, name: str) -> DataFrame:
        slim = rows.select("id", F.col("timestamp_ms").alias("at"), *[F.col(g).alias(k) for g, k in zip(given, keys, strict=True)]).dropna(subset=["at", *keys])
        return slim.withColumn("side", F.lit(name)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))

    # A number for each row among its equals: within a salt, after the salts before.
    # Both sides are written first, as they are read for the counts and again for each side's numbers.
    side(left, "l").unionByName(side(right, "r")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    equal = [*keys, "side", "at"]
    salts = rows.groupBy(*equal, "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*equal).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salts = salts.withColumn("before", before)
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy(*equal, "salt").orderBy("id"))).join(salts, [*equal, "salt"])
    numbered = numbered.select(*equal, "id", (F.col("before") + F.col("own") - 1).alias("k"))
    open_rows = salts.groupBy(*equal).agg(F.sum("n").alias("n")).withColumn("used", F.lit(0).cast("bigint"))
    matched, turn = None, 0
    while True:
        order = Window.partitionBy(*keys).orderBy("at", "side")
        earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        other = {"l": F.when(F.col("side") == "r", F.col("at")), "r": F.when(F.col("side") == "l", F.col("at"))}
        facing = lambda pick, window: F.when(F.col("side") == "l", pick(other["l"], True).over(window)).otherwise(pick(other["r"], True).over(window))
        near = open_rows.withColumn("back", F.col("at") - facing(F.last, earlier)).withColumn("ahead", facing(F.first, later) - F.col("at"))
        # The nearer of both neighbours, the earlier of two as near.
        to_next = F.col("ahead").isNotNull() & (F.col("back").isNull() | (F.col("ahead") < F.col("back"))) & (F.col("ahead") <= within_ms)
        to_last = F.col("back").isNotNull() & (F.col("ahead").isNull() | (F.col("back") <= F.col("ahead"))) & (F.col("back") <= within_ms)
        # What is nearest to each other stands side by side.
        near = near.withColumn("next", to_next).withColumn("last", to_last).withColumns(
            {"pair_next": F.col("next") & F.lead("last").over(order) & (F.lead("at").over(order) - F.col("at") == F.col("ahead")),
             "pair_last": F.col("last") & F.lag("next").over(order) & (F.col("at") - F.lag("at").over(order) == F.col("back"))}
        )
        mate = lambda name: F.when(F.col("pair_next"), F.lead(name).over(order)).when(F.col("pair_last"), F.lag(name).over(order))
        near = near.withColumns({"mate_at": mate("at"), "mate_n": mate("n"), "mate_used": mate("used")}).withColumn("taken", F.when(F.col("mate_n").isNotNull(), F.least("n", "mate_n")).otherwise(0))
        near.select(*equal, "n", "used", "taken", "mate_at", "mate_used").write.parquet(f"{folder}/{turn}")
        done = spark.read.parquet(f"{folder}/{turn}")
        pairs = done.where("side = 'l' and taken > 0").select(*keys, F.col("at").alias("l_at"), F.col("used").alias("l_used"), F.col("mate_at").alias("r_at"), F.col("mate_used").alias("r_used"), "taken")
        if pairs.isEmpty():
            break
        matched = pairs if matched is None else matched.unionByName(pairs)
        open_rows = done.select(*equal, (F.col("n") - F.col("taken")).alias("n"), (F.col("used") + F.col("taken")).alias("used")).where("n > 0")
        turn += 1
    if matched is None:
        matched = pairs
    # Rows of either side by their numbers: each of the rounds took the next ones.
    row = lambda name: numbered.where(F.col("side") == name).select(*keys, F.col("at").alias(f"{name}_at"), F.col("k").alias(f"{name}_k"), F.col("id").alias(f"{name}_id"))
    each = matched.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("taken") - 1)).alias("i"))
    each = each.withColumn("l_k", F.col("l_used") + F.col("i")).withColumn("r_k", F.col("r_used") + F.col("i"))
    found = each.join(row("l"), [*keys, "l_at", "l_k"]).join(row("r"), [*keys, "r_at", "r_k"])
    return found.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), (F.col("r_at") - F.col("l_at")).alias("apart_ms"))
