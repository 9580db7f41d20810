"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share over its present share of the bytes. Each
document draws its number of copies by inverting the Poisson distribution of that mean at a
uniform number hashed from the seed and its id; copies get hashed order keys, by which they are
dealt over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import first_positions, joined, new_folder, shared_folder, small, written

#: A Poisson variable of a larger mean is drawn as a sum of several, so that exp(-mean) stays normal.
LARGEST_MEAN = 500.0
#: A bucket of the global order is named by the first hexadecimal digits of the order key: three,
#: and as many more as leave it BUCKET_BYTES on average. The order is the same with any number.
LEAST_DIGITS, BUCKET_BYTES = 3, 256 << 20
#: Tables of more rows are not broadcast: the buckets of 268 TB.
BROADCAST_ROWS = 1 << 20


def uniform(*parts: Column) -> Column:
    """52 bits of a hash of the parts, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, source: str, text: str) -> DataFrame:
    """One row for each source: its bytes and mean repetition rate.

    Without weights all sources weigh the same; with them, a source that is not named weighs 0. The
    mixture has as many bytes as the input, on average. Sources without bytes keep rate 1.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(
        F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("mix_bytes"), F.count("*").alias("mix_rows")
    )
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    whole = sizes.where("mix_bytes > 0").agg(F.sum("mix_bytes").alias("all_bytes"), F.sum(weight).alias("all_weights"))
    rate = weight / F.col("all_weights") * F.col("all_bytes") / F.col("mix_bytes")
    return sizes.crossJoin(F.broadcast(whole)).select(  # whole: one row
        "mix_source", "mix_bytes", "mix_rows", F.when(F.col("mix_bytes") > 0, rate).otherwise(F.lit(1.0)).alias("mix_rate")
    )


def with_steps(rates: DataFrame) -> DataFrame:
    """Add the cumulative Poisson distribution of each rate as an array, up to where it is 1 within a double."""
    parts = F.greatest(F.ceil(F.col("mix_rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    mean = F.col("mix_mean")
    last = (mean + 12 * F.sqrt(mean) + 30).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("steps")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"),
            (a["c"] + a["p"] * mean / k).alias("c"),
            F.concat(a["steps"], F.array(a["c"] + a["p"] * mean / k)).alias("steps"),
        ),
    )
    return (
        rates.withColumn("mix_parts", parts)
        .withColumn("mix_mean", F.col("mix_rate") / F.col("mix_parts"))
        .withColumn("mix_steps", grown["steps"])
    )


def bucket_digits(n_bytes: int) -> int:
    """The digits that name buckets of about BUCKET_BYTES in a corpus of that size."""
    digits = LEAST_DIGITS
    while n_bytes > BUCKET_BYTES << 4 * digits:
        digits += 1
    return digits


def with_draws(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(record, draw, place) of each row: the names by which its copies are drawn and ordered.

    Both are the key, or a digest of the text where that is null. Rows that share such a name get
    their number beside it in ``place``, so that their copies are dealt out, and rows that are equal in
    text as well also in ``draw``. They are written with it, so a task that runs again finds the same.
    """
    folder = new_folder(docs.sparkSession, "mixing")
    digest = lambda column: F.concat(F.lit("null:"), F.md5(F.coalesce(column, F.lit(""))))
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("draw")).unionByName(docs.where(F.col(key).isNull()).select(digest(F.col(text)).alias("draw")))
    shared = written(named.groupBy("draw").agg(F.count("*").alias("mix_n")).where("mix_n > 1"), folder, "shared")
    rows = docs.select(F.struct("*").alias("record")).withColumn("draw", F.coalesce(F.col(f"record.{key}").cast("string"), digest(F.col(f"record.{text}"))))
    if shared.isEmpty():
        return rows.withColumn("place", F.col("draw"))
    shared = small(shared, BROADCAST_ROWS)
    again = joined(rows, shared, ["draw"], "mix_n").select("record", "draw", F.xxhash64(f"record.{text}").alias("same"), F.monotonically_increasing_id().cast("string").alias("turn"))
    again = written(again, folder, "again")
    equal = small(written(again.groupBy("draw", "same").agg(F.count("*").alias("mix_n")).where("mix_n > 1"), folder, "equal"), BROADCAST_ROWS)
    place = F.concat_ws("#", "draw", "turn")
    again = joined(again, equal, ["draw", "same"], "mix_n", "left").select("record", F.when(F.col("mix_n").isNull(), F.col("draw")).otherwise(place).alias("draw"), place.alias("place"))
    return rows.join(shared.select("draw"), "draw", "left_anti").select("record", "draw", F.col("draw").alias("place")).unionByName(again)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = 11,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The documents repeated to the target weights and shuffled globally.

    Columns: ``record`` (a struct of all input columns), ``copy`` (0, 1 ... for each document) and
    ``position`` (0, 1 ... over all copies, a random order; rows are laid out by it).

    Nulls: a null source is a source of its own; a null key is replaced by a digest of the text; a null
    text has no bytes. Rows that repeat a key with other texts draw the same number and each get so many
    copies; rows that repeat key and text draw a number each, which depends on their place in ``docs``.
    Copies of either stand apart in the order. An empty table gives no rows.
    """
    shared_folder(docs.sparkSession)  # sets the checkpoint folder where there is none
    found = with_steps(repetition_rates(docs, weights, source, text)).checkpoint()
    digits = bucket_digits(found.agg(F.sum("mix_bytes").alias("n")).first()["n"] or 0)
    rates = small(found.withColumn("mix_key", F.coalesce(F.concat(F.lit("="), F.col("mix_source")), F.lit(""))).drop("mix_source", "mix_bytes"), 10_000)
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("mix_parts") - 1),
        F.lit(0),
        lambda n, part: n
        + F.aggregate(
            F.array(uniform(F.lit(str(seed)), F.lit("draw"), part.cast("string"), F.col("draw"))),
            F.lit(0),
            lambda _, u: F.size(F.filter("mix_steps", lambda c: c <= u)),
        ),
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col("copy").cast("string"), F.col("place")))
    sourced = with_draws(docs, key, text).withColumn("mix_key", F.coalesce(F.concat(F.lit("="), F.col(f"record.{source}")), F.lit("")))
    copies = (
        joined(sourced, rates, ["mix_key"], "mix_rows")
        .select("record", "place", drawn.alias("n"))
        .where("n > 0")
        .select("record", "place", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
        .withColumn("order_key", order)
        .drop("place")
        .withColumn("bucket", F.conv(F.substring("order_key", 1, digits), 16, 10).cast("long"))
    )
    firsts = first_positions(copies.groupBy("bucket").agg(F.count("*").alias("n")))
    if 16**digits <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("order_key", F.xxhash64("record")))
    return (
        copies.repartitionByRange("bucket")
        .withColumn("within", within)
        .join(firsts, "bucket")
        .select("record", "copy", (F.col("first") + F.col("within") - 1).alias("position"))
    )


def mixed_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op4_poisson_mixing``: all copies, with equal weights for all sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("record.*", "copy", "position")


MIXED_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS mix_bytes FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN mix_bytes > 0 THEN
    1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes WHERE mix_bytes > 0)
    * (SELECT CAST(sum(mix_bytes) AS DOUBLE) FROM sizes WHERE mix_bytes > 0) / mix_bytes ELSE 1.0::DOUBLE END AS rate
  FROM sizes
), steps AS (
  SELECT source, 0 AS k, rate, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, k + 1, rate, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps
  WHERE k + 1 <= CAST(floor(rate + 12 * sqrt(rate) + 30) AS INTEGER)
), lists AS (
  SELECT source, list(c ORDER BY k) AS cs FROM steps GROUP BY source
), drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('11:draw:0:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT
    / 4503599627370496.0::DOUBLE)) AS n
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source
), copies AS (
  SELECT * EXCLUDE (n), CAST(unnest(range(n)) AS INTEGER) AS copy FROM drawn WHERE n > 0
)
SELECT *, row_number() OVER (ORDER BY md5('11:order:' || copy || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))))) - 1 AS position
FROM copies
"""
