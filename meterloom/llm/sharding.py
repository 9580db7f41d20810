"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash into buckets that fit in memory; pass two runs
Spark's Fisher-Yates ``shuffle`` over each bucket and writes it. A bucket's first position is the
number of records in the buckets before it, so the shards take equal runs of positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import first_positions, new_folder, shared_folder, small, written

#: Tables of more rows are not broadcast.
BROADCAST_ROWS = 1_000_000
#: What a task of the second pass reads, about.
TASK_BYTES = 128 << 20


def placed_in_buckets(docs: DataFrame, n_buckets: int, bucket_bytes: int, seed: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(bucket, record) of every row, and the buckets' counts (bucket, n).

    The bucket is a hash of the row's key and text. Rows that repeat both would all meet in one: where
    a bucket is over four times its size, repeated rows of more than a bucket together are written
    with a number in turn, and hashed with it.
    """
    hashed = docs.select(F.struct("*").alias("record"), F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.coalesce(F.col(text), F.lit("")))).alias("hash"))
    size = F.coalesce(F.octet_length(f"record.{text}"), F.lit(0)).cast("long") + 8
    bucket = F.pmod("hash", F.lit(n_buckets))
    count = lambda rows: rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    plain = hashed.withColumn("bucket", bucket)
    counts = count(plain).checkpoint()
    full = counts.where(F.col("bytes") > 4 * bucket_bytes).select("bucket")
    if full.isEmpty():
        return plain.select("bucket", "record"), counts
    groups = plain.join(small(full, BROADCAST_ROWS), "bucket", "left_semi").groupBy("hash").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    many = groups.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).select("hash", F.ceil(F.col("bytes") / bucket_bytes).alias("parts")).checkpoint()
    many = small(many, BROADCAST_ROWS)
    turn = F.pmod(F.monotonically_increasing_id(), F.col("parts"))
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col("hash"), turn), F.lit(n_buckets))
    # written, so that a task that runs again finds the same numbers
    spread = written(hashed.join(many, "hash").select(spread.alias("bucket"), "record"), new_folder(docs.sparkSession, "repeated"), "rows")
    every = plain.join(many, "hash", "left_anti").select("bucket", "record").unionByName(spread)
    return every, count(every).checkpoint()


def shuffle_into_shards(
    docs: DataFrame,
    path: str,
    n_shards: int = 24,
    seed: int = 17,
    bucket_bytes: int = 8 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all records of ``docs`` to ``path`` in random order, and return them as read back.

    Columns: ``record`` (a struct of all input columns, so no name can clash), ``shard`` and
    ``slot`` (0, 1, 2 ... within the shard). Shards differ by one record at most. The order
    depends on the seed, the keys and texts and the number of buckets and tasks; that of rows that
    are repeated over more than a bucket, also on their place in ``docs``.

    Nulls: a null key or text hashes like any other value and counts no bytes. Repeated rows stay
    repeated, and share buckets only up to their size. An empty table gives no rows. Texts of any
    length stay whole; a bucket has about ``bucket_bytes`` plus its longest text.
    """
    spark = docs.sparkSession
    shared_folder(spark)  # sets the checkpoint folder where there is none
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    whole = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    total, n = whole["bytes"] or 0, whole["n"]
    n_buckets = max(1, -(-total // bucket_bytes))
    scattered, counts = placed_in_buckets(docs, n_buckets, bucket_bytes, seed, key, text)
    offsets = first_positions(counts).checkpoint()
    # The number of partitions is given, so that AQE leaves it: shuffle() seeds by partition.
    n_tasks = max(1, min(n_buckets, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))))
    buckets = (
        scattered.repartition(n_tasks, "bucket")
        .sortWithinPartitions("bucket", f"record.{key}", F.crc32(f"record.{text}"))
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("records"))  # of bucket_bytes
        .select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    )
    base, extra = divmod(n, n_shards)
    position = F.col("first") + F.col("at")
    in_long = position < extra * (base + 1)
    shard = F.when(in_long, F.expr(f"(first + at) div {base + 1}")).otherwise(
        extra + F.expr(f"(first + at - {extra * (base + 1)}) div {max(base, 1)}")
    )
    start = F.col("shard") * base + F.least(F.col("shard"), F.lit(extra))
    placed = (
        buckets.join(small(offsets, BROADCAST_ROWS), "bucket")  # a row for each bucket
        .withColumn("shard", shard.cast("int"))
        .select("record", (position - start).cast("long").alias("slot"), "shard")
    )
    placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def sharded_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op9_two_pass_shuffle``: every document's place, with digests of what the shards hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = shuffle_into_shards(docs, new_folder(spark, "shards"))
    text = F.col("record.text")
    return shards.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
