"""The folder that the driver and all executors share, and files written by tasks."""

from __future__ import annotations

import sys
import tempfile
import threading
import types
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_own: dict[str, str] = {}
_made = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode a new one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.__dict__.setdefault("paths", set()).add(path)
    return path


def own_folders() -> set[str]:
    """The folders that this thread has named up to now and not removed."""
    return set(_made.__dict__.get("paths", ()))


def remove_folders(paths: set[str]) -> None:
    """Delete folders of ``new_folder`` whose tables will not be read again, and what lies below them."""
    from pyarrow import fs

    for path in paths:
        where, place = fs.FileSystem.from_uri(path)
        if where.get_file_info(place).type == fs.FileType.Directory:
            where.delete_dir(place)
        _made.__dict__.get("paths", set()).discard(path)


def written(frame: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``frame`` below ``folder`` as Parquet and read it back: the lineage ends there."""
    path = f"{folder}/{name}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int) -> DataFrame:
    """Mark ``frame`` for a broadcast if it has ``rows`` rows at most; else leave the join to Spark.

    ``frame`` should be written or checkpointed, as its rows are counted.
    """
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def joined(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner", spread: int = 64) -> DataFrame:
    """``rows`` joined with ``table``, a row for each key, whose column ``count`` says how many rows have it.

    Keys of over a ten-thousandth of all those rows, which are ten thousand at most, are dealt to
    ``spread`` tasks each. ``table`` should be written, as it is read twice. ``how``: inner or left.
    """
    whole = table.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot_from = max(whole // 10_000, 1000)
    hot = table.where(F.col(count) > hot_from).select(*on, F.lit(True).alias("hot_key"))
    if hot.isEmpty():
        return rows.join(table, on, how)
    others = [c for c in rows.columns if c not in on]
    salt = F.when(F.col("hot_key"), F.pmod(F.xxhash64(*others), F.lit(spread))).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("salt", salt.cast("int")).drop("hot_key")
    places = F.when(F.col(count) > hot_from, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(table.withColumn("salt", F.explode(places)), [*on, "salt"], how).drop("salt")


def first_positions(counts: DataFrame, span: int = 4096) -> DataFrame:
    """(bucket, first): how many rows are in the buckets before each, from (bucket, n).

    Sums run within blocks of ``span`` buckets; only the blocks, a row for each, share one window.
    """
    before = lambda n, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocked = counts.select("bucket", "n", F.expr(f"bucket div {span}").alias("block"))
    blocks = blocked.groupBy("block").agg(F.sum("n").alias("whole")).select("block", before("whole", "block").alias("base"))
    return blocked.withColumn("inner", before("n", "block", "bucket")).join(blocks, "block").select("bucket", (F.col("base") + F.col("inner")).alias("first"))


def ascii_lower(column):
    """A-Z lower-cased and nothing else; text of ASCII alone takes Spark's faster ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, upper, upper.lower())
    )


def put_file(uri: str, chunks) -> int:
    """Write chunks of bytes to ``uri`` from a task; returns the size.

    The file appears under its name when whole, so a lost or repeated task leaves no half file.
    """
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    size = 0
    with where.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    where.move(part, path)
    return size


def open_file(uri: str):
    """A seekable reader of a file in the shared folder."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def slices(batch, column: str, most: int = 4 << 20):
    """Parts of a record batch with about ``most`` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def worker_state() -> types.ModuleType:
    """A module of the Python worker that outlives its tasks, for what is costly to build and safe to share."""
    return sys.modules.setdefault("meterloom_worker_state", types.ModuleType("meterloom_worker_state"))
