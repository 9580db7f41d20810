"""The health of a live ingest: counters and the last failure, observed while batches are written, and a quarantine."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources import exports, telemetry

OBSERVED = "ingest"
COUNTERS = ("ingested", "failed", "skipped", "rejected")


class IngestHealth(StreamingQueryListener):
    """Adds up what queries with the observation ``ingest`` report with each batch; a batch counts once.

    Add it with ``spark.streams.addListener``. ``snapshot`` gives the counters, the newest time that was
    ingested, and the failure of the newest event that failed. ``before`` is a snapshot to go on from.
    """

    def __init__(self, before: dict | None = None) -> None:
        start = before or {}
        self._lock, self._batches = threading.Lock(), {}
        self._counts = {name: start.get(name, 0) for name in COUNTERS}
        self._newest, self._last = start.get("newest_ms"), (start["failed_ms"] if start.get("failed_ms") is not None else -1, start["last_failure"]) if start.get("last_failure") else None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(OBSERVED)
        if row is None:
            return
        with self._lock:
            if progress.batchId <= self._batches.get(str(progress.id), -1):
                return
            self._batches[str(progress.id)] = progress.batchId
            for name in COUNTERS:
                self._counts[name] += row[name]
            if row["newest_ms"] is not None:
                self._newest = max(self._newest or row["newest_ms"], row["newest_ms"])
            if row["last"] is not None:
                last = row["last"]["at"], row["last"]["failure"]
                self._last = max(self._last or last, last)

    def snapshot(self) -> dict:
        with self._lock:
            at, failure = self._last or (None, None)
            return {**self._counts, "newest_ms": self._newest, "failed_ms": None if at == -1 else at, "last_failure": failure}


def observed(events: DataFrame) -> DataFrame:
    """``events`` of ``telemetry.parse_bodies`` with the observation that ``IngestHealth`` reads."""
    at = F.struct(F.coalesce("timestamp_ms", F.lit(-1)).alias("at"), "failure")
    return events.observe(OBSERVED, *telemetry.metrics(), F.count_if(F.col("status") == "rejected").alias("rejected"), F.max(F.when(F.col("status") == "failed", at)).alias("last"))


def ingest_stream(bodies: DataFrame, path: str, quarantine: str, checkpoint: str, source: str = "otel", trigger: str | None = None) -> StreamingQuery:
    """Write the requests of a stream of export bodies below ``path``, and what could not be stored below ``quarantine``, in one pass.

    Quarantined are bodies that are no JSON, whole, and events that failed, with what was read of them and the
    reason. A batch that is run again replaces what it wrote in both places. All first deliveries and
    re-deliveries are stored; ``stored_requests`` and the request store keep one of each.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # parsed once, and observed once
        exports.write_batch(batch.where("status = 'ok'").drop("status", "body", "failure"), path, source, batch_id)
        exports.write_batch(batch.where("status in ('rejected', 'failed')"), quarantine, source, batch_id)
        batch.unpersist()

    writer = observed(telemetry.parse_bodies(bodies)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
