"""Live ingest: requests, sessions and transcripts as streams into tables of batches.

Every micro-batch goes to its own partition, so a batch that is run again replaces itself; the
reconciled tables are computed from all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import EPOCH, local_date
from ..operators import reconcile, rollups, transcripts
from ..operators.facets import Facets
from ..operators.measures import SPLIT, TOKENS, measures
from ..sources import exports, tables, telemetry


def stream_requests(bodies: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests from a stream of export bodies; what is delivered again within ``delay`` of its first arrival is dropped.

    Arrivals are remembered by the clock of the batches, not by the events' own times: a first delivery
    is never late, however old its request is. Rows without an id are no re-deliveries of each
    other: they get an id of their own for the test. What is delivered again later than that is caught
    when batches are reconciled.
    """
    events = telemetry.parse_otlp_events(telemetry.log_records(bodies)).where("status = 'ok'").drop("status")
    ident = F.coalesce("request_id", F.concat_ws(":", F.lit("none"), "session_id", "timestamp_ms", F.xxhash64("model", "output_tokens", "error")))
    arrived = events.withColumn("ident", ident).withColumn("arrived", F.current_timestamp())
    return arrived.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["ident"]).drop("ident", "arrived")


def write_stream(frame: DataFrame, path: str, checkpoint: str, source: str, trigger: str | None = None) -> StreamingQuery:
    """Write each micro-batch below ``path``; all that there is and then stop, unless a trigger interval is given."""
    writer = frame.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: exports.write_batch(batch, path, source, batch_id)
    )
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def store_stream(requests: DataFrame, folder: str, checkpoint: str, source: str = "otel", trigger: str | None = None) -> StreamingQuery:
    """Keep the request store and the table by day below ``folder`` up to date with a stream of requests of one source.

    Each micro-batch is applied once, however often it is run; what it writes follows its size.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        arrival = F.struct(F.lit(batch_id).cast("bigint").alias("batch_id"), "timestamp_ms", "output_tokens")
        arrivals = batch.withColumn("arrival", arrival).persist()  # read several times
        spark = batch.sparkSession
        tables.apply_arrivals(tables.RequestStore(spark, f"{folder}/requests"), tables.DayTable(spark, f"{folder}/days"), arrivals, source, batch_id)
        arrivals.unpersist()

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def today_stored(spark: SparkSession, folder: str, midnight_ms: int, next_ms: int) -> DataFrame:
    """The totals of a day from the table by day below ``folder``: no other day is read."""
    return rollups.usage_summary(tables.DayTable(spark, f"{folder}/days").read(Facets(start=midnight_ms, end=next_ms)))


def stored_requests(spark: SparkSession, path: str) -> DataFrame:
    """The reconciled requests of all batches, in which an earlier batch arrived earlier."""
    stored = spark.read.parquet(path)
    order = F.struct("batch_id", "timestamp_ms", "output_tokens")
    return reconcile.reconcile_requests(stored.withColumn("arrival", order).drop("batch_id", "batch_source"))


def stream_today(requests: DataFrame, zone: str = "UTC", keep: str | None = None) -> DataFrame:
    """Running totals of each local day, distinct sessions counted exactly, for output in ``complete`` mode.

    The first row of each day and session counts the session, all rows count for the rest, in one query and
    without reading what is stored. No row is dropped as late. The state has a key for each day and session,
    for ever or for ``keep`` after its first sight (an interval such as ``40 days``): a session of that day
    that still has rows after that is counted again.
    """
    rows = requests.withColumn("day", local_date("timestamp_ms", zone))
    seen = rows.where("session_id is not null").withColumn("arrived", F.current_timestamp())
    first = seen.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["day", "session_id"]) if keep else seen.dropDuplicates(["day", "session_id"])
    used = ["event_type", "cost_usd", *TOKENS, *SPLIT]
    sights = first.select("day", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in used], F.lit(1).alias("sight"))
    every = rows.select("day", *used, F.lit(0).alias("sight")).unionByName(sights)
    return every.groupBy("day").agg(*measures(), F.sum("sight").alias("sessions"))


def today_exactly(spark: SparkSession, path: str, midnight_ms: int, next_ms: int) -> DataFrame:
    """The totals of a day from all stored batches, which are folded for it; ``today_stored`` reads the day alone."""
    stored = stored_requests(spark, path)
    return rollups.usage_summary(stored.where((F.col("timestamp_ms") >= midnight_ms) & (F.col("timestamp_ms") < next_ms)))


def stream_sessions(payloads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Session starts (payload, seen_ms) as sightings below ``path``."""
    return write_stream(telemetry.parse_session_starts(payloads), path, checkpoint, "hook")


def stored_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions folded from all sightings."""
    return reconcile.sessions_from_hooks(spark.read.parquet(path))


def stream_transcripts(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Transcript lines below ``path``; they are collapsed over all batches when read."""
    return write_stream(lines, path, checkpoint, "transcript")


def store_transcripts(lines: DataFrame, folder: str, checkpoint: str, source: str = "transcript") -> StreamingQuery:
    """Transcript lines collapsed as they come into the store below ``folder`` (see ``tables.TranscriptStore``); each line is parsed once."""

    def add(batch: DataFrame, batch_id: int) -> None:
        tables.TranscriptStore(batch.sparkSession, folder).add(batch, source, batch_id)

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def stored_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Requests and messages collapsed from all stored lines, which are parsed for it; ``store_transcripts`` keeps them collapsed."""
    parsed = transcripts.parse_lines(spark.read.parquet(path).select("file", "pos", "line"))
    return (
        transcripts.transcript_requests(transcripts.collapse_requests(transcripts.extract_usage(parsed))),
        transcripts.collapse_messages(transcripts.extract_messages(parsed)),
    )


def event_bodies(events: DataFrame) -> DataFrame:
    """A stream or table of events as export bodies of one record each, for replays of recorded events."""
    ms = F.timestamp_diff("MILLISECOND", F.expr(EPOCH), F.col("ts"))
    text = lambda key, value: F.concat(F.lit(f'{{"key":"{key}","value":{{"stringValue":"'), value.cast("string"), F.lit('"}}'))
    attributes = F.concat_ws(
        ",",
        text("session.id", F.concat(F.lit("u-"), F.col("user_id"))),
        text("request_id", F.concat(F.lit("req_"), F.col("event_id"))),
        text("model", F.concat(F.lit("m-"), F.col("event_type"))),
        text("cost_usd", F.col("value")),
        text("input_tokens", F.col("event_id") % 100),
    )
    name = F.when(F.col("event_type") == "error", "api_error").otherwise("api_request")
    record = F.concat(F.lit('{"timeUnixNano":"'), (ms * 1_000_000).cast("string"), F.lit('","body":{"stringValue":"'), name, F.lit('"},"attributes":['), attributes, F.lit("]}"))
    return events.select(F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":['), record, F.lit("]}]}]}")).alias("body"))
