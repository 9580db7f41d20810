"""How the sources of each language differ in their words, by a frequent-pattern tree of term rows.

A term's row is the list of the sources that have it, in their order, with its counts. The distance
of two sources sums |p - q| over all terms; where neither has a term, |p - q| is one number, so a
pair starts from that number times the vocabulary and only rows that hold one or both correct it.
What a count corrects against sources without the term depends on source and count alone. What a
pair of counts corrects beside that is summed over the tree: rows that begin alike share a path, and
each node meets each of its ancestors once, with the number of rows that pass through it. Rows come
sorted, so tasks walk their part of the tree without holding it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import joined, new_folder, slices, written

#: Groups (language and source) up to this number are broadcast.
FEW_GROUPS = 50_000


def _count_terms(batches):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    letters = np.full(256, 32, np.uint8)  # all other bytes become blanks; those from 128 on belong to letters
    letters[128:] = np.arange(128, 256)
    for first in (65, 97):
        letters[first : first + 26] = np.arange(97, 123)
    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts = pa.concat_arrays([pc.cast(batch["text"], pa.large_string())])
        begin, end = (int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + i]) for i in (0, len(texts)))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] - begin
        plain = letters[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin:end]]
        lowered = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.copy()), pa.py_buffer(plain))
        lists = pc.ascii_split_whitespace(lowered)
        flat = lists.flatten().dictionary_encode()
        document = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        langs, sources = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
        terms, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        real = (pc.binary_length(terms).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.empty(0, bool)
        size = max(len(terms), 1)
        pairs, times = np.unique(document[real] * size + code[real], return_counts=True)  # a term's times in each document
        keys, place = np.unique(of[pairs // size] * size + pairs % size, return_inverse=True)
        counts, n_docs = np.zeros(len(keys), np.int64), np.bincount(place, minlength=len(keys))
        np.add.at(counts, place, times)
        # The empty term stands for all documents of the group, those without terms included.
        every, whole = np.unique(of, return_counts=True)
        at = np.concatenate([keys // size, every])
        at = [langs.dictionary.take(pa.array(at // len(sources.dictionary))), sources.dictionary.take(pa.array(at % len(sources.dictionary)))]
        names = pa.concat_arrays([pc.cast(terms, pa.string()).take(pa.array(keys % size)), pa.array([""] * len(every), pa.string())])
        yield pa.RecordBatch.from_arrays(
            [*at, names, pa.array(np.concatenate([counts, np.zeros(len(every), np.int64)])), pa.array(np.concatenate([n_docs, whole]))],
            names=["lang", "source", "term", "n", "docs"],
        )


def _walk(batches):
    """(lang, a, b, value): the corrections of pairs of counts, over the nodes and ancestors of the batches' rows."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch["path"]
        items = lists.flatten()
        g, n, p, p0 = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        coded = batch["lang"].dictionary_encode()
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weight = batch["m"].to_numpy(zero_copy_only=False)
        shared = np.zeros(len(sizes), np.int64)  # how many items a row has in common with the one before
        alive = np.flatnonzero(lang[1:] == lang[:-1]) + 1
        k = 0
        while len(alive):
            alive = alive[np.minimum(sizes[alive], sizes[alive - 1]) > k]
            here, before = offset[alive] + k, offset[alive - 1] + k
            alive = alive[(g[here] == g[before]) & (n[here] == n[before])]
            shared[alive] += 1
            k += 1
        width = int(g.max(initial=0)) + 1
        sums: dict[int, int] = {}
        for depth in range(1, int(sizes.max(initial=0))):
            rows = np.flatnonzero(sizes > depth)
            new = np.flatnonzero(shared[rows] <= depth)  # rows that begin a node at this depth
            passing = np.add.reduceat(weight[rows], new)
            firsts = rows[new]
            step = max(1, (1 << 21) // depth)
            for i in range(0, len(firsts), step):
                own = firsts[i : i + step]
                node, above = (offset[own] + depth)[:, None], offset[own][:, None] + np.arange(depth)
                both = np.abs(p[node] - p[above]) - np.abs(p[node] - p0[above]) - np.abs(p0[node] - p[above]) + np.abs(p0[node] - p0[above])
                keys, place = np.unique(((lang[own][:, None] * width + g[above]) * width + g[node]).ravel(), return_inverse=True)
                values = np.zeros(len(keys), np.int64)
                np.add.at(values, place.ravel(), (both * passing[i : i + step, None]).ravel())
                for key, value in zip(keys.tolist(), values.tolist(), strict=True):
                    sums[key] = sums.get(key, 0) + value
        keys = np.array(list(sums), np.int64)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(keys // width // width)), pa.array((keys // width % width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(list(sums.values()), pa.int64())],
            names=["lang", "a", "b", "value"],
        )


def _share(count, total: str, smoothing: int) -> Column:
    """1 + floor(10^9 * (count + smoothing) / (total + smoothing * V)), in whole numbers throughout."""
    above = (F.lit(count) if isinstance(count, int) else F.col(count)).cast("decimal(20,0)") + smoothing
    return F.when(F.col("v") > 0, (1 + F.call_function("div", above * 1_000_000_000, F.col(total) + smoothing * F.col("v"))).cast("long"))


def divergence_audit(docs: DataFrame, least: int = 30, smoothing: int = 5, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the other sources of its language, and its own terms.

    Terms are the stretches of letters, A-Z and all beyond ASCII, with only A-Z lower-cased. A language
    keeps those that ``least`` of its documents have. Each group (language and source) gives each kept term p,
    ten to the ninth times its smoothed share. Part ``pair``: the sum of |p - q| over all kept terms for each other
    source, 0 without kept terms. Part ``term``: the ``top`` terms that the group has with p above the language's.
    Ranks begin at 1 for each group and part, by falling value and then item.

    Null languages, sources and texts count as empty. Repeated rows count each; an empty table gives no rows.
    Sources are in memory by pairs nowhere but in the result, which has a row for each pair.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "divergence")
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    slim = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    partial = slim.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    counted = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))  # a source each
    rows = written(rows.where((F.col("docs") >= least) | (F.col("term") == "")).drop("docs"), folder, "rows")
    kept = rows.where("term != ''")
    cells = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("lang_n"), F.inline("counts"))

    languages = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_cells"))
    groups = rows.where("term = ''").select("lang", F.explode("counts.source").alias("source")).join(totals, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0)
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("lang_total", F.sum("total").over(of_lang)).withColumn("g", F.row_number().over(of_lang.orderBy("source")))
    groups = written(groups.withColumn("p0", _share(0, "total", smoothing)), folder, "groups")
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    on = ["lang", "source"]
    shares = cells.join(F.broadcast(groups), on) if few else joined(cells, groups, on, "n_cells")
    shares = shares.withColumn("p", _share("n", "total", smoothing)).withColumn("q", _share("lang_n", "lang_total", smoothing))

    by_value = [F.desc("value"), F.asc("item")]
    own = shares.where("n > 0 and p > q").select(*on, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = own.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy(*by_value))).where(F.col("rank") <= top)

    paths = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "n", "p", "p0"))).alias("path"))
    paths = written(paths.groupBy("lang", "path").agg(F.count("*").alias("m")), folder, "paths")
    walked = paths.where(F.size("path") > 1).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(_walk, "lang string, a int, b int, value long")
    # A source has at most sqrt(2 * its words) different counts, each of which meets the language's sources once.
    nodes = paths.select("lang", F.inline("path"), "m").groupBy("lang", "g", "n", "p", "p0").agg(F.sum("m").alias("m"))
    others = groups.select("lang", F.col("g").alias("other"), F.col("p0").alias("other_p0"))
    against = nodes.join(F.broadcast(others) if few else others, "lang").where("g != other")
    alone = against.select("lang", F.least("g", "other").alias("a"), F.greatest("g", "other").alias("b"), F.expr("m * (abs(p - other_p0) - abs(p0 - other_p0))").alias("value"))
    corrections = walked.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("correction"))
    ends = groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    base = groups.join(ends, "lang").where("g != other").withColumn("a", F.least("g", "other")).withColumn("b", F.greatest("g", "other"))  # the pairs of the result
    value = F.col("v") * F.coalesce(F.abs(F.col("p0") - F.col("other_p0")), F.lit(0)) + F.coalesce("correction", F.lit(0))
    pairs = base.join(corrections, ["lang", "a", "b"], "left").select(*on, F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy(*by_value)))
    return pairs.unionByName(terms)


def audited_sources(spark, sf_dir: str) -> DataFrame:
    """Query ``op11_pattern_tree``: how the sources of each language differ."""
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


AUDITED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), n AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), total AS (
  SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN total USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 5) // (g.total + 5 * v.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.lang_n + 5) // (v.lang_total + 5 * v.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pairs.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
