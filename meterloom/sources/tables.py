"""Stored tables that change batch by batch: requests by id, and requests by day.

A table is kept in parts, and a part in runs: folders that are written once. A manifest names the
runs that count, and which batch of each source was the last. A new manifest appears when all that
it names is written, so a batch that failed in the middle has changed nothing, and one that is
applied already changes nothing. One writer at a time; readers keep to the manifest that they opened.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import DAY_MS
from ..operators import reconcile, transcripts
from ..operators.facets import Facets
from .files import matching, put_text, read_text, remove

#: Manifests that are kept, with the runs that they name.
KEPT_VERSIONS = 2
NO_ID = "-1"


class Parts:
    """A table below ``path`` in parts by the column ``part``, each of one or more runs."""

    def __init__(self, spark: SparkSession, path: str, part: str, kind: str) -> None:
        self.spark, self.path, self.part, self.kind = spark, path.rstrip("/"), part, kind
        found = matching(spark, f"{self.path}/_manifests/*.json")
        self.manifest = json.loads(read_text(spark, found[-1])) if found else {"version": 0, "applied": {}, "columns": None, "parts": {}, "dead": []}

    def runs(self, value: str) -> list[list[int]]:
        """(version, rows) of a part's runs, the oldest first."""
        return self.manifest["parts"].get(value, [])

    def applied(self, source: str, batch_id: int) -> bool:
        return batch_id <= self.manifest["applied"].get(source, -1)

    def _folder(self, value: str, version: int) -> str:
        return f"{self.path}/{self.part}={value}/version={version}"

    def read(self, runs: dict[str, list[int]], columns: str | None = None) -> DataFrame:
        """The rows of these versions of these parts, with the column of the part."""
        schema = f"{columns or self.manifest['columns']}, `{self.part}` {self.kind}, `version` bigint"
        folders = [self._folder(value, v) for value, versions in runs.items() for v in versions]
        if not folders:
            return self.spark.createDataFrame([], schema).drop("version")
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders).drop("version")

    def write(self, rows: DataFrame, version: int) -> dict[str, int]:
        """Write ``rows`` as a run of each part that they have; the parts and their rows. Large parts are split, small ones share tasks."""
        rows.withColumn("version", F.lit(version).cast("bigint")).hint("rebalance", self.part).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(self.part, "version").parquet(self.path)
        there = [p.split("/")[-2].partition("=")[2] for p in matching(self.spark, f"{self.path}/{self.part}=*/version={version}")]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != self.part)
        counted = self.read({value: [version] for value in there}, columns).groupBy(self.part).count().collect()  # a row for each part
        self.columns = columns
        return {str(r[self.part]): r["count"] for r in counted}

    def commit(self, version: int, parts: dict[str, list[list[int]]], source: str, batch_id: int) -> None:
        """Let the manifest name these runs of the parts given; others stay as they are. Runs that no kept manifest names are removed."""
        old = self.manifest
        gone = [[value, v] for value, runs in parts.items() for v, _ in self.runs(value) if v not in {x for x, _ in runs}]
        dead = [*old["dead"], *([version, *x] for x in gone)]
        late = [x for x in dead if x[0] <= old["version"] - KEPT_VERSIONS]
        new = {
            "version": version,
            "applied": old["applied"] | {source: batch_id},
            "columns": self.columns,
            "parts": {k: v for k, v in (old["parts"] | parts).items() if v},
            "dead": [x for x in dead if x not in late],
        }
        put_text(self.spark, f"{self.path}/_manifests/{version:012d}.json", json.dumps(new))
        self.manifest = new
        for _, value, v in late:
            remove(self.spark, self._folder(value, v))
        for path in matching(self.spark, f"{self.path}/_manifests/*.json")[: -KEPT_VERSIONS - 1]:
            remove(self.spark, path)


class FoldedStore:
    """States by ``keys`` in hash buckets, folded by ``merge``: a function of states that gives one for each key, in whatever order they come.

    A batch adds a run to each bucket that it touches. A bucket's newest runs are folded into one when
    they are together as large as half the run before them, so runs grow by a factor: a bucket has a
    logarithmic number of them, and a row is written again as often. What is written follows the batch.
    States with a null key are kept beside the buckets; ``merge`` passes them on.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64) -> None:
        self.parts, self.keys, self.merge, self.buckets = Parts(spark, path, "bucket", "int"), keys, merge, buckets

    def _bucketed(self, states: DataFrame) -> DataFrame:
        keyless = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in self.keys))
        bucket = F.when(keyless, int(NO_ID)).otherwise(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)))
        return states.withColumn("bucket", bucket.cast("int"))

    def add(self, states: DataFrame, source: str, batch_id: int) -> bool:
        """Add a batch of states, one for each key; false if that batch of the source was there already."""
        parts = self.parts
        if parts.applied(source, batch_id):
            return False
        version = parts.manifest["version"] + 1
        added = parts.write(self._bucketed(states), version)
        runs = {value: [*parts.runs(value), [version, n]] for value, n in added.items()}
        due = {}
        for value, own in runs.items():
            at, rows = len(own) - 1, own[-1][1]
            while at and own[at - 1][1] <= 2 * rows:
                at -= 1
                rows += own[at][1]
            if at < len(own) - 1:
                due[value] = at
        if due:
            version += 1
            read = parts.read({value: [v for v, _ in runs[value][at:]] for value, at in due.items()}, parts.columns)
            folded = parts.write(self._bucketed(self.merge(read.drop("bucket"))), version)
            runs |= {value: [*runs[value][:at], [version, folded[value]]] for value, at in due.items()}
        parts.commit(version, runs, source, batch_id)
        return True

    def states(self) -> DataFrame:
        """A state for each key, from all runs; buckets of a single run are read as they are."""
        parts = self.parts
        one = {v: [r[0] for r in runs] for v, runs in parts.manifest["parts"].items() if len(runs) == 1 or v == NO_ID}
        more = {v: [r[0] for r in runs] for v, runs in parts.manifest["parts"].items() if v not in one}
        return parts.read(one).drop("bucket").unionByName(self.merge(parts.read(more).drop("bucket")))


class RequestStore(FoldedStore):
    """What has arrived, folded by request id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        super().__init__(spark, path, ["request_id"], reconcile.merge_states, buckets)

    def upsert(self, arrivals: DataFrame, source: str, batch_id: int) -> bool:
        """Add a batch of ``arrivals`` (see ``reconcile.reconcile_requests``); false if that batch of the source was there already."""
        return self.add(reconcile.fold_arrivals(arrivals), source, batch_id)

    def requests(self) -> DataFrame:
        """The reconciled requests, as ``reconcile.reconcile_requests`` gives them for all batches together."""
        return reconcile.requests_of(self.states())


class TranscriptStore:
    """Requests and messages of transcript lines that come batch by batch; a line is parsed when it comes and not again.

    Kept are the last line of each request of a file, as ``transcripts.collapse_requests`` and
    ``collapse_messages`` choose it, and all messages of users.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        keys = ["file", "request_id"]
        self.usage = FoldedStore(spark, f"{path}/usage", keys, transcripts.collapse_requests, buckets)
        self.said = FoldedStore(spark, f"{path}/messages", keys, transcripts.collapse_messages, buckets)

    def add(self, lines: DataFrame, source: str, batch_id: int) -> None:
        """Add a batch of lines (file, pos, line); a batch that was there already changes nothing."""
        if self.usage.parts.applied(source, batch_id) and self.said.parts.applied(source, batch_id):
            return
        parsed = transcripts.parse_lines(lines.select("file", "pos", "line")).persist()
        self.usage.add(transcripts.collapse_requests(transcripts.extract_usage(parsed)), source, batch_id)
        self.said.add(transcripts.collapse_messages(transcripts.extract_messages(parsed)), source, batch_id)
        parsed.unpersist()

    def requests(self) -> DataFrame:
        """Backfill requests, as the batch operators give them for all lines."""
        return transcripts.transcript_requests(self.usage.states())

    def messages(self) -> DataFrame:
        """Messages, as the batch operators give them for all lines."""
        return self.said.states()


def day_of(timestamp_ms: Column) -> Column:
    """The UTC day of epoch milliseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(timestamp_ms / DAY_MS).cast("int"))


class DayTable:
    """Requests stored by UTC day, for queries over a range of time: other days' folders are not even listed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.parts = Parts(spark, path, "day", "date")

    def read(self, facets: Facets = Facets()) -> DataFrame:
        """The requests of the days that the facets' bounds leave, cut to the bounds; the other facets are left to ``apply_facets``."""
        start, end = facets.start, facets.end
        first = None if start is None else start // DAY_MS
        last = None if end is None else (end - 1) // DAY_MS
        number = lambda value: (_date(value) - _date("1970-01-01")).days
        kept = {v: [r[0] for r in runs] for v, runs in self.parts.manifest["parts"].items() if (first is None or number(v) >= first) and (last is None or number(v) <= last)}
        rows = self.parts.read(kept)
        if first is not None:
            rows = rows.where((F.col("day") >= day_of(F.lit(start))) & (F.col("timestamp_ms") >= start))
        if last is not None:
            rows = rows.where((F.col("day") <= day_of(F.lit(end - 1))) & (F.col("timestamp_ms") < end))
        return rows.drop("day")

    def replace(self, requests: DataFrame, source: str = "all", batch_id: int = 0) -> bool:
        """Write ``requests`` as the whole of each day that they have; other days stay. False if that batch was there already."""
        return self._put(requests, set(), source, batch_id)

    def apply(self, before: DataFrame, after: DataFrame, source: str, batch_id: int) -> bool:
        """Put ``after`` in the place of ``before``, both rows of requests; only the days of either are written again.

        Rows of ``before`` are known by their ids; those without an id stay, and those of ``after`` are added.
        """
        if self.parts.applied(source, batch_id):
            return False
        days = before.select(day_of(F.col("timestamp_ms")).alias("day")).unionByName(after.select(day_of(F.col("timestamp_ms")).alias("day"))).distinct()
        touched = {str(r["day"]) for r in days.collect()}  # of a batch, a row for each day
        if not self.parts.manifest["parts"]:
            return self._put(after, touched, source, batch_id)
        old = self.parts.read({v: [r[0] for r in self.parts.runs(v)] for v in touched}).drop("day")
        ids = before.unionByName(after).where("request_id is not null").select("request_id").distinct()
        return self._put(old.join(ids, "request_id", "left_anti").unionByName(after), touched, source, batch_id)

    def _put(self, requests: DataFrame, touched: set[str], source: str, batch_id: int) -> bool:
        parts = self.parts
        if parts.applied(source, batch_id):
            return False
        version = parts.manifest["version"] + 1
        counts = parts.write(requests.withColumn("day", day_of(F.col("timestamp_ms"))), version)
        parts.commit(version, {v: [] for v in touched} | {v: [[version, n]] for v, n in counts.items()}, source, batch_id)
        return True


def _date(text: str):
    from datetime import date

    return date.fromisoformat(text)


def apply_arrivals(store: RequestStore, days: DayTable, arrivals: DataFrame, source: str, batch_id: int) -> None:
    """Add a batch of arrivals to ``store`` and the requests that it changes to ``days``.

    The days are written first: a batch that failed between the two is applied to both when it comes again,
    as what changes is computed from the store, which does not have it yet.
    """
    new = reconcile.fold_arrivals(arrivals)
    known = store.states() if store.parts.manifest["parts"] else new.limit(0)
    old = known.join(new.where("request_id is not null").select("request_id"), "request_id", "left_semi")
    if not days.parts.applied(source, batch_id):
        days.apply(reconcile.requests_of(old), reconcile.requests_of(reconcile.merge_states(old.unionByName(new))), source, batch_id)
    store.upsert(arrivals, source, batch_id)
