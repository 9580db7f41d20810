"""Prices of requests: layered price lists, the match of model names, and the cost formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.parsing import model_key, undated

RATES = ("input_rate", "output_rate", "cache_read_rate", "cache_5m_rate", "cache_1h_rate")


def layer_prices(*layers: DataFrame) -> DataFrame:
    """One price for each model: that of the last layer that has the model."""
    ranked = [x.withColumn("priority", F.lit(i)) for i, x in enumerate(layers)]
    every = reduce(lambda a, b: a.unionByName(b), ranked)
    best = every.groupBy("model").agg(F.max_by(F.struct(*RATES), "priority").alias("best"))
    return best.select("model", "best.*")


def resolve_prices(models: DataFrame, prices: DataFrame, column: str = "model") -> DataFrame:
    """(``column``, rates) for the distinct names in ``models``; nulls where no price fits.

    Looked up in turn: the bare name, the name without its date, the newest dated price of a name
    without one. Names are few, so the join back to requests can be a broadcast.
    """
    rates = F.struct(*RATES)
    exact = prices.select(F.col("model").alias("bare"), rates.alias("exact"))
    cut = prices.select(F.col("model").alias("stripped"), rates.alias("cut"))
    newest = (
        prices.where(undated(F.col("model")) != F.col("model"))
        .groupBy(undated(F.col("model")).alias("bare"))
        .agg(F.max_by(rates, "model").alias("newest"))
    )
    names = models.select(column).distinct().withColumn("bare", model_key(F.col(column))).withColumn("stripped", undated(F.col("bare")))
    found = names.join(exact, "bare", "left").join(cut, "stripped", "left").join(newest, "bare", "left")
    return found.select(column, F.coalesce("exact", "cut", "newest").alias("rates")).select(column, "rates.*")


def cost():
    """Cost from tokens and rates. Cache writes of no known life cost the five-minute rate; null rates give null."""
    five, hour = F.col("cache_creation_5m_tokens"), F.col("cache_creation_1h_tokens")
    known = five.isNotNull() | hour.isNotNull()
    at_5m, at_1h = F.coalesce(five, F.lit(0)), F.coalesce(hour, F.lit(0))
    rest = F.greatest(F.col("cache_creation_tokens") - at_5m - at_1h, F.lit(0))
    split = (at_5m + rest) * F.col("cache_5m_rate") + at_1h * F.col("cache_1h_rate")
    writes = F.when(known, split).otherwise(F.col("cache_creation_tokens") * F.col("cache_5m_rate"))
    return (
        F.col("input_tokens") * F.col("input_rate")
        + F.col("output_tokens") * F.col("output_rate")
        + F.col("cache_read_tokens") * F.col("cache_read_rate")
        + writes
    )


def price_requests(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests with a cost where it was null and their model has a price; errors stay without."""
    found = resolve_prices(requests, prices).withColumnRenamed("model", "priced_model")
    joined = requests.join(found, F.col("model").eqNullSafe(F.col("priced_model")), "left")
    priced = F.when(F.col("cost_usd").isNull() & (F.col("event_type") == "api_request"), cost()).otherwise(F.col("cost_usd"))
    return joined.withColumn("cost_usd", priced).select(*requests.columns)


def first_per_request(requests: DataFrame) -> DataFrame:
    """The earliest row of each request id; rows without one all stay."""
    order = Window.partitionBy("request_id").orderBy("timestamp_ms", "source")
    numbered = requests.where("request_id is not null").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return numbered.unionByName(requests.where("request_id is null"))
