"""Daily partial sums that add up to summaries over any days and facets, distinct sessions included.

Sessions are numbered densely, and a partial has a bitmap of the numbers it has seen: bitmaps of days
are united, so a session that runs over several of them counts once, and exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import local_date
from .facets import from_main
from .measures import SPLIT, TOKENS, measures, money, summed

SALTS = 1024


def number_sessions(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, number): dense numbers from 0 on; those in ``known`` stay and new sessions come after them.

    Numbers run within buckets of a hash, on top of the sessions in the buckets before: a window over one
    partition has a row for each bucket. Null sessions have no number.
    """
    own = requests.where("session_id is not null").select("session_id").distinct()
    first = F.lit(0).cast("bigint")
    if known is not None:
        own = own.join(known, "session_id", "left_anti")
        first = F.lit((known.agg(F.max("number").alias("n")).first()["n"] or -1) + 1).cast("bigint") if not known.isEmpty() else first
    own = own.withColumn("salt", F.pmod(F.xxhash64("session_id"), F.lit(SALTS)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = own.groupBy("salt").agg(F.count("*").alias("n")).select("salt", before.alias("base"))
    numbered = own.withColumn("k", F.row_number().over(Window.partitionBy("salt").orderBy("session_id"))).join(F.broadcast(bases), "salt")  # 1024 rows
    new = numbered.select("session_id", (first + F.col("base") + F.col("k") - 1).alias("number"))
    return new if known is None else known.unionByName(new)


def daily_partials(requests: DataFrame, numbers: DataFrame, zone: str = "UTC") -> DataFrame:
    """Measures by (day, model, main, bucket) and ``bits``: the sessions of that bucket of 32,768 numbers; a null bucket has none.

    Requests are summed by session first, so a session that many share is one row in the join. ``main`` is
    false for subagents. Partials of other requests may be put beside these, of whatever days.
    """
    keys = [local_date("timestamp_ms", zone).alias("day"), "model", from_main(F.col("query_source")).alias("main")]
    by_session = requests.groupBy(*keys, "session_id").agg(*measures()).join(numbers, "session_id", "left")
    number = F.col("number")
    bucket = F.when(number.isNotNull(), F.bitmap_bucket_number(number))
    return by_session.groupBy("day", "model", "main", bucket.alias("bucket")).agg(*summed(), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def summary_of_partials(partials: DataFrame) -> DataFrame:
    """One row, as ``rollups.usage_summary`` gives it for the requests of these partials."""
    by_bucket = partials.groupBy("bucket").agg(*summed(), F.bitmap_or_agg("bits").alias("bits"))
    sessions = F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))), F.lit(0)).alias("sessions")
    columns = ["cost_usd", *TOKENS, *SPLIT, "requests", "errors", "unpriced", "sessions"]
    return by_bucket.agg(*summed(), sessions).select(*columns).withColumn("cost_usd", money(F.col("cost_usd")))
