"""Growing JSON-lines files read batch by batch, however many there are.

Spark lists the files; each that has changed is looked at and read in tasks, by byte ranges. How far
each file was read is a table beside the lines, and a small manifest names its version and the
batches that count. So a batch that failed in the middle is read again as a whole, and what the
driver holds does not grow with the files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .files import matching, put_text, read_text, remove
from .transcripts import LINES, SPAN_BYTES

#: What is remembered of a file's beginning, to see that it was replaced.
HEAD_BYTES = 1024
STATE = "file string, length bigint, modified timestamp, read_to bigint, head bigint, head_bytes bigint"


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, length, modified) of every ``*.jsonl`` below ``root``; no file is opened, large trees are listed by tasks. A missing folder has none."""
    from pyspark.errors import AnalysisException

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    try:
        found = reader.load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, length bigint, modified timestamp")
    return found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def _open(uri: str):
    """A seekable reader of a file, wherever it is."""
    import io

    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:]
    where, path = fs.FileSystem.from_uri(uri)
    return io.BufferedReader(where.open_input_file(path), 1 << 16)


def _line_end(f, start: int, stop: int, length: int, step: int = 1 << 16) -> int:
    """The place after the last newline in [start, stop), or else after the first one behind it; ``start`` if there is none."""
    end = stop
    while end > start:
        begin = max(start, end - step)
        f.seek(begin)
        k = f.read(end - begin).rfind(b"\n")
        if k >= 0:
            return begin + k + 1
        end = begin
    at = stop
    while at < length:
        f.seek(at)
        data = f.read(min(step, length - at))
        k = data.find(b"\n")
        if k >= 0:
            return at + k + 1
        if not data:
            break
        at += len(data)
    return start


def _prober(share: int | None):
    """What to read of each changed file, and what to remember of it. A file that cannot be opened is left for the next batch."""

    def probe(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                length, known = row["length"], row["read_to"] or 0
                try:
                    with _open(row["file"]) as f:
                        head = f.read(row["head_bytes"] or 0)
                        start = known if length >= known and zlib.crc32(head) == (row["head"] or 0) else 0
                        stop = _line_end(f, start, length if share is None else min(length, start + share), length)
                        f.seek(0)
                        head = f.read(min(HEAD_BYTES, stop))
                except OSError:
                    continue
                out.append({"file": row["file"], "length": length, "modified": row["modified"], "start": start, "stop": stop, "head": zlib.crc32(head), "head_bytes": len(head), "whole": share is None or start + share >= length})
            if out:
                kinds = {"file": pa.string(), "length": pa.int64(), "modified": batch.schema.field("modified").type, "start": pa.int64(), "stop": pa.int64(), "head": pa.int64(), "head_bytes": pa.int64(), "whole": pa.bool_()}
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    return probe


def _read_spans(batches):
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("line", pa.string())])
    for batch in batches:
        for span in batch.to_pylist():
            rows, size = [], 0
            with _open(span["file"]) as f:
                at = span["begin"]
                if at > span["start"]:  # a line that began before is the span's before
                    f.seek(at - 1)
                    at += len(f.readline()) - 1
                f.seek(at)
                while at < span["end"]:
                    line = f.readline()
                    if not line:
                        raise OSError(f"{span['file']} lost what was to be read of it")
                    rows.append({"file": span["file"], "pos": at, "line": line.rstrip(b"\r\n").decode("utf-8", "replace")})
                    at += len(line)
                    size += len(line)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Tail:
    """The lines below ``folder`` that were read from the files below ``root``. One writer at a time.

    ``most_bytes`` bounds a batch: each changed file gives an equal share of it, but a line at least, so no file
    waits for another. ``span`` is what one task reads of a file.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, most_bytes: int | None = None, span: int = SPAN_BYTES) -> None:
        self.spark, self.root, self.folder, self.most_bytes, self.span = spark, root, folder.rstrip("/"), most_bytes, span
        found = matching(spark, f"{self.folder}/_manifests/*.json")
        self.manifest = json.loads(read_text(spark, found[-1])) if found else {"version": 0, "batches": 0}

    def _state(self) -> DataFrame:
        if not self.manifest["version"]:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/state/version={self.manifest['version']}")

    def step(self) -> bool:
        """Read one batch of what the files gained; false if no file has changed since the last.

        An unterminated last line waits for the next batch. A file that is shorter than what was read of it, or
        whose first kilobyte changed, was replaced and is read from its start; files that are gone are
        forgotten. A file that is cut while its batch is read fails the batch, which then changes nothing.
        """
        version, state = self.manifest["version"] + 1, self._state()
        known = state.select("file", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), "read_to", "head", "head_bytes")
        listed = listed_files(self.spark, self.root).join(known, "file", "left")
        changed = ~(F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified")))
        work = f"{self.folder}/work/version={version}"
        remove(self.spark, work)
        listed.withColumn("changed", changed).write.parquet(f"{work}/listed")
        listed = self.spark.read.parquet(f"{work}/listed")
        n_changed = listed.where("changed").count()
        if not n_changed and listed.count() == state.count():
            remove(self.spark, work)
            return False
        share = None if self.most_bytes is None else max(1, self.most_bytes // max(1, n_changed))
        tasks = max(1, min(n_changed, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        probed = listed.where("changed").select("file", "length", "modified", "read_to", "head", "head_bytes").repartition(tasks)
        probed.mapInArrow(_prober(share), "file string, length bigint, modified timestamp, start bigint, stop bigint, head bigint, head_bytes bigint, whole boolean").write.parquet(f"{work}/probed")
        probed = self.spark.read.parquet(f"{work}/probed")
        spans = probed.where("stop > start").select("file", "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(self.span))).alias("begin"))
        spans = spans.withColumn("end", F.least(F.col("begin") + self.span, "stop")).drop("stop").repartition(tasks)
        spans.mapInArrow(_read_spans, LINES).write.mode("overwrite").parquet(f"{self.folder}/lines/batch={self.manifest['batches']}")
        # A file of which a share alone was read counts as changed the next time.
        new = probed.select("file", F.when(F.col("whole"), F.col("length")).otherwise(-1).alias("length"), "modified", F.col("stop").alias("read_to"), "head", "head_bytes")
        left = state.join(listed.select("file"), "file", "left_semi").join(probed.select("file"), "file", "left_anti")
        left.select(*new.columns).unionByName(new).write.mode("overwrite").parquet(f"{self.folder}/state/version={version}")
        before, self.manifest = self.manifest["version"], {"version": version, "batches": self.manifest["batches"] + 1}
        put_text(self.spark, f"{self.folder}/_manifests/{version:012d}.json", json.dumps(self.manifest))
        remove(self.spark, work)
        remove(self.spark, f"{self.folder}/state/version={before - 1}")
        remove(self.spark, f"{self.folder}/_manifests/{before - 1:012d}.json")
        return True

    def lines(self, first: int = 0) -> DataFrame:
        """(file, pos, line, batch) of the batches from ``first`` on; ``pos`` is the line's byte offset."""
        batches = range(first, self.manifest["batches"])
        schema = f"{LINES}, batch int"
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/lines").parquet(*[f"{self.folder}/lines/batch={b}" for b in batches])


def tail_stream(spark: SparkSession, root: str, folder: str, checkpoint: str, seconds: int = 5, most_bytes: int | None = None) -> StreamingQuery:
    """Take a step of ``Tail`` every ``seconds``, and more while there is more, until the query is stopped."""

    def steps(batch: DataFrame, batch_id: int) -> None:
        tail = Tail(spark, root, folder, most_bytes)
        while tail.step():
            pass

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(steps).trigger(processingTime=f"{seconds} seconds").start()
