"""Transcript files: JSON lines in files that grow."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINES = "file string, pos bigint, line string"
#: What one task of a stream reads of a file.
SPAN_BYTES = 64 << 20


def read_transcripts(spark: SparkSession, root: str, files=None) -> DataFrame:
    """(file, pos, line) of every ``*.jsonl`` below ``root``; no rows where there is no such folder.

    ``files``: a condition on ``_metadata``, which prunes files before they are read.

    ``pos`` grows along each file. Files that cannot be read are skipped. The place is taken at the
    scan: the block of the file and the row's number in its partition, which reads blocks in order.
    """
    from pyspark.errors import AnalysisException

    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("ignoreCorruptFiles", "true")
    try:
        lines = reader.text(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LINES)
    # 33 low bits number the rows of a partition; a block's start alone orders rows of different blocks.
    lines = lines if files is None else lines.where(files)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") * 1024 + within).alias("pos"),
        F.col("value").alias("line"),
    )


def read_window(spark: SparkSession, root: str, start_ms: int, slack_ms: int = 3_600_000) -> DataFrame:
    """(file, pos, line) of the files that may have lines of a window that starts at ``start_ms``.

    A line is written after its time, so files last written ``slack_ms`` before the start have none.
    """
    before = F.timestamp_millis(F.lit(start_ms - slack_ms))
    return read_transcripts(spark, root, F.col("_metadata.file_modification_time") >= before)


def changed_since(spark: SparkSession, root: str, iso_time: str) -> DataFrame:
    """The lines of the files that were written after a time (``yyyy-MM-ddTHH:mm:ss``)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("modifiedAfter", iso_time)
    return reader.text(root).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def unreadable_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, length) of the transcripts below ``root`` that have bytes and of which no line can be read.

    Files are listed without being opened, then read as ``read_transcripts`` does; empty files are
    readable, and a missing folder has none.
    """
    from pyspark.errors import AnalysisException

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    try:
        listed = reader.load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, length bigint")
    read = read_transcripts(spark, root).select("file").distinct()
    return listed.select(F.col("_metadata.file_path").alias("file"), "length").where("length > 0").join(read, "file", "left_anti")


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class GrowingFilesReader(DataSourceStreamReader):
    """Reads what files gained since the last batch; the offset maps each path to bytes read.

    An unterminated last line waits for the next batch; a file shorter than its offset is read from
    its start; a file that did not change is not opened. What a file gained is read by a task for
    every ``span`` bytes, each of which reads the lines that begin in its span. Files that cannot be
    opened when they are looked for are left for the next batch; one that fails in a task fails it,
    so that no line is passed over.
    """

    def __init__(self, root: str, span: int = SPAN_BYTES) -> None:
        self.root, self.span = root, span

    def initialOffset(self) -> dict:
        return {}

    def _ends(self) -> dict[str, int]:
        ends = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.endswith(".jsonl"):
                    path = os.path.join(folder, name)
                    try:
                        ends[path] = os.path.getsize(path)
                    except OSError:  # gone since the folder was listed
                        continue
        return ends

    def latestOffset(self) -> dict:
        known = getattr(self, "known", {})
        offset = {}
        for path, size in self._ends().items():
            if path in known and known[path][0] == size:
                offset[path] = known[path][1]
                continue
            try:
                offset[path] = _last_line_end(path, size)
            except OSError:
                if path in known:
                    offset[path] = known[path][1]
                continue
            known[path] = (size, offset[path])
        self.known = known
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if stop < begin else begin
            spans += [_Span(path, at, min(at + self.span, stop)) for at in range(begin, stop, self.span)]
        return spans

    def read(self, partition: _Span):
        with open(partition.path, "rb") as f:
            at = partition.start
            if at:  # a line that began before is the span's before; at the end of a line this reads its newline alone
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


def _last_line_end(path: str, size: int, step: int = 1 << 16) -> int:
    """The place after the last newline within the first ``size`` bytes."""
    with open(path, "rb") as f:
        end = size
        while end > 0:
            begin = max(0, end - step)
            f.seek(begin)
            k = f.read(end - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            end = begin
    return 0


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("path", folder)``: the folder is one that driver and executors share.

    The option ``span`` says how many bytes of a file one task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(self.options["path"], int(self.options.get("span", SPAN_BYTES)))


def tail_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (file, pos, line); ``pos`` is the line's byte offset."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", root).load()
