"""Small files on whatever file system a path names, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of ``spark.checkpoint.dir``; in local mode below one of our own where that is unset."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern matches, in order."""
    system, where = _place(spark, pattern)
    return sorted(found.getPath().toString() for found in system.globStatus(where) or ())


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    system, where = _place(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file, which appears under its name when it is whole."""
    system, where = _place(spark, path)
    _, part = _place(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = system.create(part)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(where) or not system.rename(part, where):
        system.delete(part, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder and all below it, if it is there."""
    system, where = _place(spark, path)
    system.delete(where, True)
