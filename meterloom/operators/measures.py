"""The measures that all rollups share, and sums of their partial results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
SPLIT = ("cache_creation_5m_tokens", "cache_creation_1h_tokens")
COUNTS = ("requests", "errors", "unpriced")
#: Double sums depend on their order in the last bits; money is given to a millionth of a dollar.
DIGITS = 6



def money(column: Column) -> Column:
    return F.round(column, DIGITS)


def measures() -> list[Column]:
    """Cost, tokens and counts of request rows, 0 over none; the 5m/1h split is null where no row has it.

    A null cost adds nothing, but its row counts as unpriced if it is a request. Errors are no requests.
    """
    request = F.col("event_type") == "api_request"
    return [
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS],
        *[F.sum(t).alias(t) for t in SPLIT],
        F.count_if(request).alias("requests"),
        F.count_if(F.col("event_type") == "api_error").alias("errors"),
        F.count_if(request & F.col("cost_usd").isNull()).alias("unpriced"),
    ]


def summed() -> list[Column]:
    """The same measures from partial ones."""
    return [
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS],
        *[F.sum(t).alias(t) for t in SPLIT],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
    ]


def total_tokens() -> Column:
    return sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))


def hit_rate() -> Column:
    """Cache reads over cache reads and inputs, null without either."""
    return F.try_divide(F.col("cache_read_tokens"), F.col("cache_read_tokens") + F.col("input_tokens"))
