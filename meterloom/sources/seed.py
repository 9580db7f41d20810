"""A usage table of any size made by rule, for scale runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import DAY_MS

DAYS, SESSIONS, PROJECTS = 75, 600, 12
MODELS = ("model-large", "model-medium", "model-small")


def seed_usage(spark: SparkSession, rows: int, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` requests over 75 days, an eighth of them in the last one, and their 600 sessions."""
    i = F.col("id")
    recent = i % 8 == 0
    spread = F.pmod(F.xxhash64(F.lit(1), i), F.when(recent, F.lit(DAY_MS)).otherwise(F.lit(DAYS * DAY_MS)))
    session = F.concat(F.lit("session-"), (F.pmod(F.xxhash64(F.lit(2), i), F.lit(SESSIONS))).cast("string"))
    error, k = i % 400 == 0, F.pmod(F.xxhash64(F.lit(3), i), F.lit(1000))
    writes = F.when(error, 0).otherwise(k % 8 * 100).cast("bigint")
    split = (i % 4 == 0) & ~error
    requests = spark.range(rows).select(
        F.concat(F.lit("req-"), i.cast("string")).alias("request_id"),
        F.when(i % 23 == 0, F.concat(F.lit("orphan-"), (i % 97).cast("string"))).otherwise(session).alias("session_id"),
        (F.lit(now_ms) - spread).alias("timestamp_ms"),
        F.when(~error, F.element_at(F.array(*map(F.lit, MODELS)), (i % 3 + 1).cast("int"))).alias("model"),
        F.when(i % 6 == 0, "subagent").alias("query_source"),
        F.when(~error & (i % 500 != 1), k / 1000.0).alias("cost_usd"),
        F.when(error, 0).otherwise(k).cast("bigint").alias("input_tokens"),
        F.when(error, 0).otherwise(k * 7).cast("bigint").alias("output_tokens"),
        F.when(error, 0).otherwise(k * 1000).cast("bigint").alias("cache_read_tokens"),
        writes.alias("cache_creation_tokens"),
        F.when(split, F.floor(writes * 3 / 4)).cast("bigint").alias("cache_creation_5m_tokens"),
        F.when(split, writes - F.floor(writes * 3 / 4)).cast("bigint").alias("cache_creation_1h_tokens"),
        F.when(error, "api_error").otherwise("api_request").alias("event_type"),
        F.when(error, "overloaded").alias("error"),
        k.alias("duration_ms"),
        F.lit("otel").alias("source"),
    )
    s = F.col("id")
    sessions = spark.range(SESSIONS).select(
        F.concat(F.lit("session-"), s.cast("string")).alias("session_id"),
        F.when(s % 19 != 0, F.concat(F.lit("/home/dev/project-"), (s % PROJECTS).cast("string"))).alias("cwd"),
        F.lit(now_ms - DAYS * DAY_MS).alias("first_seen_ms"),
        F.lit(now_ms).alias("last_seen_ms"),
        F.lit("hook").alias("source"),
    )
    return requests, sessions
