"""URL filters from a sorted digest array.

Tasks write the rule set as files: the sorted 64-bit xxhash keys of the rules, the places of their
strings, and the strings. A URL's own keys, of every host suffix and path prefix that a rule could
have, are columns. Tasks map the files into memory, probe them with vectorised binary search for all
keys of a batch at once, and compare the full strings of what is hit, so a collision of keys decides
nothing.

Rules are dealt to files by key, as many as keep a file near ``SHARD_BYTES``. Up to ``SHIPPED_BYTES``
every executor gets all files, and the URLs stay where they are; of a larger rule set each task gets
one file, and the keys of distinct URLs are dealt to the files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from .shared import new_folder, open_file, put_file, written

SHARD_BYTES, SHIPPED_BYTES = 64 << 20, 1 << 30
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_key(host: Column, path: Column) -> Column:
    """The xxhash64 of host, a zero byte and path."""
    return F.xxhash64(F.concat(host, F.lit("\0"), path))


def rule_table(spark, rules) -> DataFrame:
    """(rule_host, rule_path, verdict, key), the last rule for each host and path, from rules in order.

    ``rules`` is a sequence of ``UrlRule``, or a DataFrame (verdict, host, path, place) of any size whose
    ``place`` orders it. Rules with a null in host, path or verdict fit nothing and are left out.
    """
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place long")
    last = rules.dropna(subset=["verdict", "host", "path"]).groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    return last.agg(F.max_by("verdict", "place").alias("verdict")).withColumn("key", rule_key(F.col("rule_host"), F.col("rule_path")))


def _digest_writer(folder: str):
    def write(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for shard, keys, strings in zip(*(batch[c].to_pylist() for c in ("shard", "keys", "strings")), strict=True):
                texts = [x.encode() for x in strings]
                head = [np.array([len(keys)], "<u8"), np.array(keys, "<i8"), np.cumsum([len(x) for x in texts], dtype="<u8")]
                path = f"{folder}/{folder.rpartition('/')[2]}-{shard}.digests"  # a name of its own, as Spark ships files by name
                put_file(path, [*(x.tobytes() for x in head), *texts])
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([path])], names=["shard", "path"])

    return write


def write_digests(table: DataFrame, folder: str, n_shards: int) -> list[str]:
    """Write ``rule_table`` as ``n_shards`` digest files at most, by key modulo their number; returns their paths.

    Layout, little-endian: number of rules u64, the sorted keys i64, the strings' ends u64, and for
    each rule its verdict, a zero byte, its host, a zero byte and its path.
    """
    text = F.concat_ws("\0", "verdict", "rule_host", "rule_path")
    listed = table.groupBy(F.pmod("key", F.lit(n_shards)).cast("long").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("key", text.alias("text")))).alias("rules"))
    columns = listed.select("shard", F.col("rules.key").alias("keys"), F.col("rules.text").alias("strings"))
    return [r["path"] for r in columns.mapInArrow(_digest_writer(folder), "shard long, path string").collect()]  # a row for each file


class DigestArray:
    """A digest file mapped into memory, or read where it can't be."""

    def __init__(self, data: str | bytes) -> None:
        import numpy as np

        raw = np.memmap(data, np.uint8, "r") if isinstance(data, str) else np.frombuffer(data, np.uint8)
        n = int(raw[:8].view("<u8")[0])
        self.keys, self.ends, self.strings = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u8", n, 8 + 8 * n), raw[8 + 16 * n :]

    def find(self, keys):
        """(place among ``keys``, rule) for each rule of a key, by binary search: keys may collide."""
        import numpy as np

        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        counts = hi - lo
        places = np.repeat(np.arange(len(keys)), counts)
        return places, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)

    def rule(self, i: int) -> tuple[str, str, str]:
        """(verdict, host, path)."""
        text = self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()
        return tuple(text.decode().split("\0", 2))


def _best(digests: list[tuple[int, DigestArray]], batch, n_shards: int):
    """The first rule found or None for each row (host, path, tries); tries are in the order of preference."""
    import numpy as np

    tries = batch["tries"]
    starts = tries.offsets.to_numpy() - tries.offsets[0].as_py()
    flat = tries.flatten()
    keys = flat.field("key").to_numpy(zero_copy_only=False)
    hits = []
    for shard, digest in digests:
        own = np.flatnonzero(keys % n_shards == shard)
        places, rules = digest.find(keys[own])
        hits += [(int(own[p]), digest, r) for p, r in zip(places.tolist(), rules.tolist(), strict=True)]
    found = [None] * batch.num_rows
    hits.sort(key=lambda x: x[0])
    rows = np.searchsorted(starts, [x[0] for x in hits], "right") - 1
    for (at, digest, rule), row in zip(hits, rows.tolist(), strict=True):
        if found[row] is None:
            verdict, host, path = digest.rule(rule)
            one = flat[at].as_py()
            own_host, own_path = batch["host"][row].as_py(), batch["path"][row].as_py()
            if len(host) == one["h"] and len(path) == one["p"] and own_host.endswith(host) and own_path.startswith(path):
                found[row] = {"rule": host + path, "verdict": verdict, "p": len(path), "h": len(host)}
    return found


FOUND = "struct<rule:string,verdict:string,p:int,h:int>"


def _prober(paths: list[str], n_shards: int, columns: tuple[str, ...], shipped: bool):
    """Adds ``found`` to ``columns``: over all files, shipped to the executor, or over the one that a row's ``shard`` names."""
    names = {int(p.rpartition("-")[2].partition(".")[0]): p for p in paths}
    kind = [("rule", "string"), ("verdict", "string"), ("p", "int32"), ("h", "int32")]

    def probe(batches):
        import pyarrow as pa

        struct = pa.struct([(n, pa.type_for_alias(t)) for n, t in kind])
        opened: dict[int, DigestArray] = {}
        if shipped:
            opened = {s: DigestArray(SparkFiles.get(p.rpartition("/")[2])) for s, p in names.items()}
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                if shipped:
                    found = _best(list(opened.items()), batch, n_shards)
                else:
                    own, found = batch["shard"].to_pylist(), [None] * batch.num_rows
                    for shard in sorted(set(own) & set(names)):
                        if shard not in opened:
                            with open_file(names[shard]) as f:
                                opened = {shard: DigestArray(f.read())}  # rows come by shard
                        for i, x in enumerate(_best(list(opened.items()), batch, n_shards)):
                            found[i] = x if own[i] == shard else found[i]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(found, struct)], names=[*columns, "found"])

    return probe


def filter_urls(pages: DataFrame, rules=RULES, otherwise: str = "allow", url: str = "url", shipped_bytes: int = SHIPPED_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``record`` (a struct of all columns), ``host``, ``path``, ``rule`` and ``verdict`` for each row.

    The longest rule decides, of equal lengths that of the longer host. Null URLs and those without
    ``://`` have empty host and path, and get ``otherwise``, as all do that no rule fits. Equal URLs get
    equal verdicts; an empty rule set gives ``otherwise``; an empty table gives no rows. URLs may be of
    any length.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "rules")
    table = written(rule_table(spark, rules), folder, "table")
    facts = table.agg(
        F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + F.octet_length("verdict") + 18).alias("bytes"),
        F.array_sort(F.collect_set(F.char_length("rule_path"))).alias("lengths"),  # as many as there are lengths
    ).first()
    parsed = pages.select(F.struct("*").alias("record"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not facts["bytes"]:
        return parsed.select("record", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    n_shards = -(-facts["bytes"] // shard_bytes)
    paths = write_digests(table, folder, n_shards)
    lengths = F.array(*[F.lit(n) for n in facts["lengths"]])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tries = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                F.filter(lengths, lambda n: n <= F.char_length("path")),
                lambda n: F.struct(
                    (F.char_length(s) + n).alias("n"), F.char_length(s).alias("h"), n.alias("p"), rule_key(s, F.substring(F.col("path"), F.lit(1), n)).alias("key")
                ),
            ),
        )
    )
    tries = F.sort_array(tries, asc=False).alias("tries")
    if facts["bytes"] <= shipped_bytes:
        for path in paths:
            spark.sparkContext.addFile(path)  # Spark ships it to each executor once
        schema = f"record {parsed.schema['record'].dataType.simpleString()}, host string, path string, found {FOUND}"
        found = parsed.select("record", "host", "path", tries).mapInArrow(_prober(paths, n_shards, ("record", "host", "path"), True), schema)
    else:
        distinct = parsed.select("host", "path").distinct().select("host", "path", F.explode(tries).alias("try"))
        dealt = distinct.groupBy("host", "path", F.pmod("try.key", F.lit(n_shards)).cast("long").alias("shard")).agg(F.sort_array(F.collect_list("try"), asc=False).alias("tries"))
        # eight tasks share a file, as many URLs may have one host
        dealt = dealt.repartition(8 * n_shards, "shard", F.pmod(F.xxhash64("host", "path"), F.lit(8))).sortWithinPartitions("shard")
        hits = dealt.mapInArrow(_prober(paths, n_shards, ("host", "path"), False), f"host string, path string, found {FOUND}").where("found is not null")
        best = F.max_by("found", F.struct(F.col("found.p") + F.col("found.h"), F.col("found.h")))
        found = parsed.join(hits.groupBy("host", "path").agg(best.alias("found")), ["host", "path"], "left")
    return found.select("record", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict"))


def judged_pages(spark, sf_dir: str) -> DataFrame:
    """Query ``op5_digest_array``: every page's verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("record.page_id", "host", "path", "rule", "verdict")


JUDGED_SQL = r"""
WITH parsed AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT rid, verdict, h || p AS rule, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rid)
"""
