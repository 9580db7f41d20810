"""The metering tables derived from the given tables by rules that both engines can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.calendar import EPOCH

#: What counts as now: the end of the events' last day.
NOW_MS = 1_706_659_200_000
DAY_MS = 86_400_000
REQUEST_COLUMNS = (
    "request_id", "session_id", "timestamp_ms", "model", "query_source", "cost_usd", "input_tokens", "output_tokens", "cache_read_tokens",
    "cache_creation_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "event_type", "error", "duration_ms", "source",
)


#: Tasks for each core of rows that are dealt out.
SHARES = 4


def dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows in turn to a few tasks for each core, before work that is large against what is read: files may have fewer splits than there are cores."""
    return rows.repartition(max(SHARES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def requests(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Every event as a request; ``deal``: see ``dealt``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = dealt(spark, e) if deal else e
    i, k = F.col("event_id"), F.col("k")
    failed = F.col("event_type") == "error"
    split = ~failed & (i % 4 == 0)
    tokens = lambda value: F.when(failed, F.lit(0)).otherwise(value).cast("bigint")
    five = F.expr("(k % 8 * 100) * 3 div 4").cast("bigint")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).select(
        F.concat(F.lit("req_"), i.cast("string")).alias("request_id"),
        F.when(i % 97 == 0, None)
        .when(i % 23 == 0, F.concat(F.lit("orphan-"), F.col("user_id").cast("string")))
        .otherwise(F.concat_ws("-", F.lit("s"), F.col("user_id").cast("string"), day))
        .alias("session_id"),
        F.timestamp_diff("MILLISECOND", F.expr(EPOCH), F.col("ts")).alias("timestamp_ms"),
        F.when(~failed, F.concat(F.lit("m-"), "event_type")).alias("model"),
        F.when(i % 6 == 0, "subagent").when(i % 6 > 2, "user").alias("query_source"),
        F.when(~failed & (i % 50 != 0), F.col("value")).alias("cost_usd"),
        tokens(20 + k).alias("input_tokens"),
        tokens(100 + 7 * k).alias("output_tokens"),
        tokens(1000 * k).alias("cache_read_tokens"),
        tokens(k % 8 * 100).alias("cache_creation_tokens"),
        F.when(split, five).alias("cache_creation_5m_tokens"),
        F.when(split, k % 8 * 100 - five).cast("bigint").alias("cache_creation_1h_tokens"),
        F.when(failed, "api_error").otherwise("api_request").alias("event_type"),
        F.when(failed, F.concat(F.lit("overloaded, \"try\" again "), i.cast("string"))).alias("error"),
        (i % 1000).alias("duration_ms"),
        F.when(split, "backfill").otherwise("otel").alias("source"),
    )


REQUESTS_SQL = """
requests AS (
  SELECT 'req_' || event_id AS request_id,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'orphan-' || user_id ELSE 's-' || user_id || '-' || strftime(ts, '%Y-%m-%d') END AS session_id,
    epoch_us(ts) // 1000 AS timestamp_ms,
    CASE WHEN event_type <> 'error' THEN 'm-' || event_type END AS model,
    CASE WHEN event_id % 6 = 0 THEN 'subagent' WHEN event_id % 6 > 2 THEN 'user' END AS query_source,
    CASE WHEN event_type <> 'error' AND event_id % 50 <> 0 THEN value END AS cost_usd,
    CASE WHEN event_type = 'error' THEN 0 ELSE 20 + k END AS input_tokens,
    CASE WHEN event_type = 'error' THEN 0 ELSE 100 + 7 * k END AS output_tokens,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1000 * k END AS cache_read_tokens,
    CASE WHEN event_type = 'error' THEN 0 ELSE k % 8 * 100 END AS cache_creation_tokens,
    CASE WHEN event_type <> 'error' AND event_id % 4 = 0 THEN (k % 8 * 100) * 3 // 4 END AS cache_creation_5m_tokens,
    CASE WHEN event_type <> 'error' AND event_id % 4 = 0 THEN k % 8 * 100 - (k % 8 * 100) * 3 // 4 END AS cache_creation_1h_tokens,
    CASE WHEN event_type = 'error' THEN 'api_error' ELSE 'api_request' END AS event_type,
    CASE WHEN event_type = 'error' THEN 'overloaded, "try" again ' || event_id END AS error,
    event_id % 1000 AS duration_ms,
    CASE WHEN event_type <> 'error' AND event_id % 4 = 0 THEN 'backfill' ELSE 'otel' END AS source
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session of the events that is neither missing nor an orphan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 97 != 0 and event_id % 23 != 0")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    ms = F.timestamp_diff("MILLISECOND", F.expr(EPOCH), F.col("ts"))
    spans = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min(ms).alias("first_seen_ms"), F.max(ms).alias("last_seen_ms"))
    return (
        spans.join(customers, "user_id", "left")
        .join(nations, "c_nationkey", "left")
        .select(
            F.concat_ws("-", F.lit("s"), F.col("user_id").cast("string"), "day").alias("session_id"),
            F.when(F.col("user_id") % 19 != 0, F.concat(F.lit("/home/dev/"), "n_name")).alias("cwd"),
            "first_seen_ms",
            "last_seen_ms",
            F.lit("hook").alias("source"),
        )
    )


SESSIONS_SQL = """
sessions AS (
  SELECT 's-' || user_id || '-' || day AS session_id, CASE WHEN user_id % 19 <> 0 THEN '/home/dev/' || n_name END AS cwd, first_seen_ms, last_seen_ms, 'hook' AS source
  FROM (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(min(ts)) // 1000 AS first_seen_ms, epoch_us(max(ts)) // 1000 AS last_seen_ms
    FROM events WHERE event_id % 97 <> 0 AND event_id % 23 <> 0 GROUP BY ALL
  ) LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation as a message whose parent is the turn before it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    uuid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))))
    return c.select(
        uuid.alias("uuid"),
        F.concat(F.lit("c-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.when(F.col("role") == "assistant", F.concat_ws("_", F.lit("creq"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("request_id"),
        F.lag(uuid).over(Window.partitionBy("conv_id").orderBy("turn")).alias("parent_uuid"),
        "role",
        (NOW_MS - DAY_MS + F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp_ms"),
        (F.col("turn") % 7 == 0).alias("is_sidechain"),
        block.alias("content"),
        F.lit(None).cast("string").alias("tool_use_result"),
        "conv_id",
        "turn",
        "text",
    )


MESSAGES_SQL = f"""
messages AS (
  SELECT conv_id || ':' || turn AS uuid, 'c-' || conv_id AS session_id, CASE WHEN role = 'assistant' THEN 'creq_' || conv_id || '_' || turn END AS request_id,
    lag(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_uuid, role, {NOW_MS - DAY_MS} + conv_id * 1000 + turn AS timestamp_ms,
    turn % 7 = 0 AS is_sidechain, conv_id, turn, text
  FROM conversations
)"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests, with every tenth one a second time from the other source, and an order of arrival."""
    r = requests(spark, sf_dir).withColumn("n", F.substring("request_id", 5, 20).cast("bigint"))
    again = r.where("n % 10 = 0").withColumn("source", F.when(F.col("source") == "otel", "backfill").otherwise("otel"))
    again = again.withColumn("output_tokens", F.col("output_tokens") + 1).withColumn("arrival", F.col("n") * 2 - 15)
    return r.withColumn("arrival", F.col("n") * 2).unionByName(again).drop("n")


ARRIVALS_SQL = REQUESTS_SQL + """,
arrivals AS (
  SELECT *, CAST(substr(request_id, 5) AS BIGINT) * 2 AS arrival FROM requests
  UNION ALL BY NAME
  SELECT * EXCLUDE (output_tokens, source), output_tokens + 1 AS output_tokens, CASE source WHEN 'otel' THEN 'backfill' ELSE 'otel' END AS source, CAST(substr(request_id, 5) AS BIGINT) * 2 - 15 AS arrival
  FROM requests WHERE CAST(substr(request_id, 5) AS BIGINT) % 10 = 0
)"""


def order_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A larger table: every line item as a request of its order's session, and the orders as sessions."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quantity = F.col("l_quantity").cast("bigint")
    r = li.select(
        F.concat_ws("_", F.lit("li"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("request_id"),
        F.concat(F.lit("o-"), F.col("l_orderkey").cast("string")).alias("session_id"),
        F.timestamp_diff("MILLISECOND", F.expr(EPOCH), F.col("l_shipdate")).alias("timestamp_ms"),
        F.concat(F.lit("m-"), "l_returnflag").alias("model"),
        F.when(F.col("l_linestatus") == "O", "subagent").alias("query_source"),
        F.col("l_extendedprice").alias("cost_usd"),
        quantity.alias("input_tokens"),
        (quantity * 3).alias("output_tokens"),
        (quantity * 100).alias("cache_read_tokens"),
        (quantity * 10).alias("cache_creation_tokens"),
        F.lit(None).cast("bigint").alias("cache_creation_5m_tokens"),
        F.lit(None).cast("bigint").alias("cache_creation_1h_tokens"),
        F.lit("api_request").alias("event_type"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.lit("otel").alias("source"),
    )
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s = o.select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("session_id"), F.concat(F.lit("/home/dev/"), F.col("o_orderpriority")).alias("cwd"))
    return r, s


ORDER_REQUESTS_SQL = """
requests AS (
  SELECT 'li_' || l_orderkey || '_' || l_linenumber AS request_id, 'o-' || l_orderkey AS session_id, epoch_us(l_shipdate) // 1000 AS timestamp_ms, 'm-' || l_returnflag AS model,
    CASE WHEN l_linestatus = 'O' THEN 'subagent' END AS query_source, l_extendedprice AS cost_usd, CAST(l_quantity AS BIGINT) AS input_tokens,
    CAST(l_quantity AS BIGINT) * 3 AS output_tokens, CAST(l_quantity AS BIGINT) * 100 AS cache_read_tokens, CAST(l_quantity AS BIGINT) * 10 AS cache_creation_tokens,
    CAST(NULL AS BIGINT) AS cache_creation_5m_tokens, CAST(NULL AS BIGINT) AS cache_creation_1h_tokens, 'api_request' AS event_type, 'otel' AS source
  FROM lineitem
), sessions AS (SELECT 'o-' || o_orderkey AS session_id, '/home/dev/' || o_orderpriority AS cwd FROM orders)"""
