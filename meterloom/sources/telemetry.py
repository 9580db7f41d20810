"""Telemetry: OTLP/JSON log bodies, session-start payloads, quota payloads and price lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import double_value, event_name, event_time_ms, first_attribute, int_value, reset_time_ms

VALUE = "stringValue:string,intValue:string,doubleValue:string"
RECORD = f"timeUnixNano:string,observedTimeUnixNano:string,body:struct<stringValue:string>,attributes:array<struct<key:string,value:struct<{VALUE}>>>"
BODY = f"resourceLogs array<struct<scopeLogs:array<struct<logRecords:array<struct<{RECORD}>>>>>>"
#: The attributes that are read.
ATTRIBUTES = (
    "event.name", "session.id", "request_id", "model", "query_source", "cost_usd", "input_tokens", "output_tokens", "cache_read_tokens",
    "cache_creation_tokens", "error", "duration_ms",
)
KEPT_EVENTS = ("api_request", "api_error")
QUOTA_WINDOWS = ("five_hour", "seven_day", "seven_day_sonnet", "seven_day_opus")


def read_otlp_logs(spark, path: str, streaming: bool = False) -> DataFrame:
    """(body): one export body for each line of the text files below ``path``."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path).withColumnRenamed("value", "body")


def rejected_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies that are no JSON, for quarantine."""
    return bodies.where(F.try_parse_json("body").isNull())


def log_records(bodies: DataFrame) -> DataFrame:
    """A row for each log record; a missing level has none."""
    top = bodies.select(F.from_json("body", BODY).alias("b"))
    return (
        top.select(F.explode("b.resourceLogs").alias("r"))
        .select(F.explode("r.scopeLogs").alias("s"))
        .select(F.explode("s.logRecords").alias("record"))
    )


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """All that became of export bodies, in one pass: the columns of ``parse_otlp_events``, and ``body`` and ``failure``.

    A body that is no JSON is a row of the status ``rejected`` with its ``body``, which all other rows leave
    null; ``failure`` says why an event failed. A body without records has no row.
    """
    top = bodies.select("body", F.from_json("body", BODY).alias("b"))
    # Only what has no records is parsed a second time.
    rejected = F.col("b.resourceLogs").isNull() & F.try_parse_json("body").isNull()
    logs = top.select(F.when(rejected, F.coalesce("body", F.lit(""))).alias("body"), F.explode_outer("b.resourceLogs").alias("r"))
    records = logs.select("body", F.explode_outer("r.scopeLogs").alias("s")).select("body", F.explode_outer("s.logRecords").alias("record"))
    events = parse_otlp_events(records.where("body is not null or record is not null"), "body")
    events = events.withColumn("status", F.when(F.col("body").isNotNull(), "rejected").otherwise(F.col("status")))
    return events.withColumn("failure", F.when(F.col("status") == "failed", failure_text()))


def parse_otlp_events(records: DataFrame, *more: str) -> DataFrame:
    """Request columns with ``status``: ok, skipped (another event) or failed (no session or no time), and the columns ``more`` of the records.

    Only these attributes are read: whatever names a user or an organisation is left behind.
    """
    # Generators, so that an attribute is looked for once, however often its value is read.
    values = [first_attribute(F.col("record.attributes"), key).alias(key.replace(".", "_")) for key in ATTRIBUTES]
    found = records.select("record", *more, F.explode(F.array(F.struct(*values))).alias("a"))
    text = lambda key: F.col(f"a.{key}.stringValue")
    facts = F.struct(
        event_name(text("event_name"), F.col("record.body.stringValue")).alias("name"),
        F.nullif(text("session_id"), F.lit("")).alias("session"),
        event_time_ms(F.col("record")).alias("time"),
    )
    found = found.select("a", *more, F.explode(F.array(facts)).alias("f"))
    missing = F.concat_ws(", ", F.when(F.col("f.session").isNull(), F.lit("no session")), F.when(F.col("f.time").isNull(), F.lit("no time")))
    status = F.when(~F.coalesce(F.col("f.name").isin(*KEPT_EVENTS), F.lit(False)), "skipped").when(missing != "", "failed").otherwise("ok")
    count = lambda key: F.coalesce(int_value(F.col(f"a.{key}")), F.lit(0)).alias(key)
    return found.select(
        text("request_id").alias("request_id"),
        F.col("f.session").alias("session_id"),
        F.col("f.time").alias("timestamp_ms"),
        text("model").alias("model"),
        text("query_source").alias("query_source"),
        double_value(F.col("a.cost_usd")).alias("cost_usd"),
        count("input_tokens"),
        count("output_tokens"),
        count("cache_read_tokens"),
        count("cache_creation_tokens"),
        F.lit(None).cast("bigint").alias("cache_creation_5m_tokens"),
        F.lit(None).cast("bigint").alias("cache_creation_1h_tokens"),
        F.col("f.name").alias("event_type"),
        text("error").alias("error"),
        int_value(F.col("a.duration_ms")).alias("duration_ms"),
        F.lit("otel").alias("source"),
        status.alias("status"),
        *more,
    )


def failure_text() -> Column:
    """Why an event failed: its kind, its request and what it lacks."""
    missing = F.concat_ws(", ", F.when(F.col("session_id").isNull(), F.lit("no session")), F.when(F.col("timestamp_ms").isNull(), F.lit("no time")))
    return F.concat(F.coalesce("event_type", F.lit("")), F.lit(" "), F.coalesce("request_id", F.lit("without id")), F.lit(": "), missing)


def last_failure(events: DataFrame) -> DataFrame:
    """(timestamp_ms, failure): why the newest event that failed did; no row where none did."""
    failed = events.where("status = 'failed'")
    newest = F.max(F.struct(F.coalesce("timestamp_ms", F.lit(-1)).alias("at"), failure_text().alias("failure"))).alias("last")
    return failed.agg(newest).where("last is not null").select(F.nullif(F.col("last.at"), F.lit(-1)).alias("timestamp_ms"), "last.failure")


def ingest_metrics(events: DataFrame) -> DataFrame:
    """One row: ingested, failed and skipped events, and the newest time that was ingested."""
    return events.agg(*metrics())


def metrics() -> list[Column]:
    """The columns of ``ingest_metrics``, for an aggregate or for ``observe``."""
    return [
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "ingested"), ("failed", "failed"), ("skipped", "skipped"))],
        F.max(F.when(F.col("status") == "ok", F.col("timestamp_ms"))).alias("newest_ms"),
    ]


def parse_session_starts(payloads: DataFrame) -> DataFrame:
    """(session_id, cwd, seen_ms) from (payload, seen_ms); a payload without a session is left out, an empty folder is null."""
    parsed = payloads.select(F.from_json("payload", "session_id string, cwd string").alias("p"), "payload", "seen_ms")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.session_id", "variant")) == "STRING"
    return parsed.where(F.coalesce(is_text, F.lit(False)) & (F.col("p.session_id") != "")).select(
        F.col("p.session_id").alias("session_id"), F.nullif(F.col("p.cwd"), F.lit("")).alias("cwd"), "seen_ms"
    )


def parse_quota_snapshots(payloads: DataFrame) -> DataFrame:
    """(fetched_ms, window, utilization, resets_at_ms) from (fetched_ms, payload): a row for each window that is there."""
    window = "struct<utilization:double,resets_at:string>"
    parsed = payloads.select("fetched_ms", F.from_json("payload", ", ".join(f"{w} {window}" for w in QUOTA_WINDOWS)).alias("q"))
    rows = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"q.{w}").alias("w")) for w in QUOTA_WINDOWS])
    return (
        parsed.select("fetched_ms", F.explode(rows).alias("x"))
        .where("x.w is not null")
        .select("fetched_ms", "x.window", "x.w.utilization", reset_time_ms(F.col("x.w.resets_at")).alias("resets_at_ms"))
    )


def parse_price_list(texts: DataFrame, name_prefix: str = "claude", provider: str | None = "anthropic") -> DataFrame:
    """Prices by model from (text): a JSON object of entries by model.

    Kept are names with the prefix, of the provider or of none, with finite rates that are not
    negative. Missing cache rates are 0.1, 1.25 and 2 times the input rate.
    """
    entry = (
        "struct<litellm_provider:string,input_cost_per_token:double,output_cost_per_token:double,cache_read_input_token_cost:double,"
        "cache_creation_input_token_cost:double,cache_creation_input_token_cost_above_1hr:double>"
    )
    rows = texts.select(F.explode(F.from_json("text", f"map<string,{entry}>")).alias("model", "e"))
    given, out = F.col("e.input_cost_per_token"), F.col("e.output_cost_per_token")
    sound = lambda rate: rate.isNotNull() & (rate >= 0) & (rate < float("inf"))
    rate = lambda name, factor: F.coalesce(F.when(sound(F.col(f"e.{name}")), F.col(f"e.{name}")), given * factor)
    own = F.lit(True) if provider is None else F.coalesce(F.col("e.litellm_provider") == provider, F.lit(True))
    return rows.where(F.col("model").startswith(name_prefix) & own & sound(given) & sound(out)).select(
        "model",
        given.alias("input_rate"),
        out.alias("output_rate"),
        rate("cache_read_input_token_cost", 0.1).alias("cache_read_rate"),
        rate("cache_creation_input_token_cost", 1.25).alias("cache_5m_rate"),
        rate("cache_creation_input_token_cost_above_1hr", 2.0).alias("cache_1h_rate"),
    )
