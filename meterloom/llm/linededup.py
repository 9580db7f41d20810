"""Line deduplication against levelled sorted runs of line hashes.

Documents come in batches of ascending ids. A run is a table of (line hash, first document), sorted
by hash and bucketed, so that a batch's hashes merge with it without the run being shuffled. Each
batch looks its lines up in all runs, and its own new hashes become a run of level 0; when a level
has ``fanout`` runs they are merged into one of the next level. A manifest beside the runs names
them, so a later crawl goes on from there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import joined, new_folder, open_file, put_file, remove_folders, slices, written

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
HASH = ["h1", "h2"]


def _line_hashes(lines, least: int):
    """Two 64-bit halves of the hash of each line's key, and whether the key is long enough."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=BLANK))
    long = pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(long)
    digests = b"".join(xxhash.xxh3_128_digest(k.encode()) for k in keys.take(kept).to_pylist())
    return kept, np.frombuffer(digests, "<i8").reshape(-1, 2)


def _split(texts):
    """All lines of the texts, and where each text's lines start; a null text is one empty line."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _hasher(least: int):
    def hash_lines(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole, "text")):
            lines, starts = _split(batch["text"])
            kept, hashes = _line_hashes(lines, least)
            row = np.searchsorted(starts, kept, "right") - 1
            # A line is named once for each document.
            distinct = np.unique(np.column_stack([row, hashes]), axis=0) if len(kept) else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(distinct[:, 0])), batch["own"].take(pa.array(distinct[:, 0])), pa.array(distinct[:, 1]), pa.array(distinct[:, 2])],
                names=["doc_id", "own", *HASH],
            )

    return hash_lines


def _rewriter(least: int):
    def rewrite(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole, "text")):
            lines, starts = _split(batch["text"])
            n_lines = np.diff(starts)
            n_dropped = np.zeros(batch.num_rows, np.int64)
            texts = batch["text"].to_pylist()
            drops = batch["drops"]
            for i in np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = lines.slice(starts[i], n_lines[i])
                kept, hashes = _line_hashes(own, least)
                gone = {(x["h1"], x["h2"]) for x in drops[i].as_py()}
                out = {int(k) for k, h in zip(kept, hashes.tolist(), strict=True) if tuple(h) in gone}
                n_dropped[i] = len(out)
                texts[i] = "\n".join(x for k, x in enumerate(own.to_pylist()) if k not in out)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_lines), pa.array(n_dropped), pa.array(texts, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )

    return rewrite


class LineRuns:
    """The levelled runs below ``folder``; ``add`` takes batches in the order of precedence of their documents.

    Runs that a manifest in ``folder`` names are opened again, with the number of buckets they were
    written with. A run's rows name the call (a number from 1 on) that added them, so that what an
    earlier call knows is told from this one's own ids. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 2) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout
        try:
            with open_file(f"{folder}/manifest.json") as f:
                manifest = json.loads(f.read())
        except FileNotFoundError:
            manifest = {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [], "calls": 0}
        self.buckets, self.levels, self.call = manifest["buckets"], manifest["levels"], manifest["calls"] + 1
        self.merged: list[str] = []
        for name in self._names():
            columns = f"h1 bigint, h2 bigint, holder bigint, call int) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns} LOCATION '{folder}/{name}'")

    def _names(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def save(self) -> None:
        """Write the manifest: what was added up to here is there when the runs are opened again.

        Then the files of runs that were merged into others are removed, as no manifest names them any more.
        """
        put_file(f"{self.folder}/manifest.json", [json.dumps({"buckets": self.buckets, "levels": self.levels, "calls": self.call}).encode()])
        remove_folders({f"{self.folder}/{name}" for name in self.merged})
        self.merged = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._write(merged.repartition(self.buckets, *HASH), level + 1)
            self._forget(full)
            self.merged += full

    def _forget(self, names: list[str]) -> None:
        for name in names:  # the tables are external: their files stay
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """(doc_id, own, h1, h2): the lines of the batch to drop, from ``lines`` of these columns. The batch's new lines become a run.

        A line that an earlier call knows goes whatever the ids; one of this call stays where its holder has it.
        """
        firsts = lines.groupBy(*HASH).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        for i, run in enumerate(self._names()):
            older = self.spark.table(run).select(*HASH, F.struct("call", "holder").alias(f"known{i}"))
            firsts = firsts.join(older, HASH, "left")
        n_runs = sum(map(len, self.levels))
        known = F.coalesce(*[F.col(f"known{i}") for i in range(n_runs)], F.lit(None).cast("struct<call:int,holder:bigint>")).alias("known")
        looked = written(firsts.select(*HASH, "first", "n", known), new_folder(self.spark, "lines-looked"), "looked")
        new = looked.where("known is null").select(*HASH, F.col("first").alias("holder"), F.lit(self.call).alias("call"))
        self._write(new.repartition(self.buckets, *HASH), 0)
        earlier = F.coalesce(F.col("known.call") < self.call, F.lit(False)).alias("earlier")
        holders = looked.where("known is not null or n > 1").select(*HASH, F.coalesce("known.holder", "first").alias("holder"), earlier, "n")
        return joined(lines, holders, HASH, "n").where("earlier or doc_id != holder").select("doc_id", "own", *HASH)

    def close(self) -> None:
        """Forget the tables' names; their files and the manifest stay."""
        self._forget(self._names())


def drop_repeated_lines(docs: DataFrame, least: int = 10, n_batches: int = 3, key: str = "doc_id", text: str = "text", runs_folder: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of ``docs``, ``text`` without repeated lines.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
    ``least`` code points or more are kept in the smallest id that has them and dropped elsewhere.
    Null and empty texts are one empty line, and a null text comes out null. A null id is smaller
    than no other: its row drops lines that others have, and holds none. Rows that share an id are
    one document to others and each loses what the other rows' ids hold, nothing to each other; null ids
    are such rows too, and each is worked on by itself, however many there are. An empty table gives no
    rows. All batches together give what one would.

    With ``runs_folder``, lines of earlier calls with that folder are dropped too, whatever the ids, and
    the lines of this one are there for the next. Without, the runs serve this call alone.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lines")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shares = [i / n_batches for i in range(1, n_batches)]
    cuts = sorted(set(slim.agg(F.percentile_approx("doc_id", shares, 1000).alias("cuts")).first()["cuts"] or ())) if shares else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    # A null id is no holder; the largest id stands for it.
    last = (1 << 63) - 1
    # Rows of one id and equal hashes of the text lose the same lines, should the texts differ too.
    slim = slim.select(F.coalesce("doc_id", F.lit(last)).alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    hashed = slim.mapInArrow(_hasher(least), "doc_id long, own long, h1 long, h2 long").withColumn("batch", batch)
    path = f"{folder}/hashed"
    hashed.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(hashed.schema).parquet(path)
    runs, drops = LineRuns(spark, runs_folder or folder), []
    for i in range(len(cuts) + 1):
        drops.append(written(runs.add(hashed.where(F.col("batch") == i).drop("batch")), folder, f"drops-{i}"))
    if runs_folder:
        runs.save()
    runs.close()
    every = drops[0]
    for more in drops[1:]:
        every = every.unionByName(more)
    row = ["doc_id", "own"]
    lists = every.groupBy(*row, *HASH).agg(F.count("*").alias("n")).groupBy(*row).agg(F.collect_list(F.struct(*HASH)).alias("drops"), F.max("n").alias("n"))  # of one text
    found = joined(slim, written(lists, folder, "lists"), row, "n", "left").select("doc_id", "text", "drops")
    out = found.mapInArrow(_rewriter(least), "doc_id long, n_lines long, n_dropped long, text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(last)))


def deduplicated_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op6_levelled_runs``: what each document loses, and a digest of the rest."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


DEDUPLICATED_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), flagged AS (
  SELECT k.*, f.holder IS NOT NULL AND f.holder <> k.doc_id AS dropped FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY rid, doc_id
"""
