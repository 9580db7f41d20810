"""Exports of requests and of rollups as CSV, and idempotent writes of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.parsing import below_home, iso_ms


def export_rows(requests: DataFrame, sessions: DataFrame, home: str = "", exclude_sessionless: bool = False) -> DataFrame:
    """All matching requests, errors included, in 15 columns and a stable order."""
    rows = requests.where("session_id is not null") if exclude_sessionless else requests
    joined = rows.join(sessions.select("session_id", "cwd"), "session_id", "left")
    order = ["session_id"] if exclude_sessionless else []
    return joined.orderBy(*order, "timestamp_ms", "request_id").select(
        "timestamp_ms",
        iso_ms(F.col("timestamp_ms")).alias("timestamp"),
        "model",
        "query_source",
        "cost_usd",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        "cache_creation_5m_tokens",
        "cache_creation_1h_tokens",
        "event_type",
        F.substring("error", 1, 500).alias("error"),
        "session_id",
        below_home(F.col("cwd"), home).alias("project"),
    )


def write_csv(frame: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, lines ended with CR LF, nulls empty."""
    frame.write.option("header", "true").option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_batch(frame: DataFrame, path: str, source: str, batch_id: int) -> None:
    """Write a micro-batch to its own partition; the same batch again replaces it."""
    frame.write.mode("overwrite").parquet(f"{path}/batch_source={source}/batch_id={batch_id}")


def export_summary(series: DataFrame, path: str) -> None:
    """A rollup's rows with money to a millionth, as CSV."""
    write_csv(series, path)
