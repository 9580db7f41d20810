"""Benchmark decontamination with a distributed positional inverted index.

The index stores postings (term, document, position) of the training texts for the terms of the
test items. It is partitioned by document: each task writes a segment of its own documents' postings,
sorted by term, so building it shuffles nothing. A window of a test item is
looked up by its two rarest terms, whose postings are taken out of the segments once: those of the
rarest give alignments (item, document, shift), which those of the second rarest, adjusted by
their offset, must confirm. The alignments left are intersected with the postings of all the
item's terms; runs of matches as long as a window are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import ascii_lower, new_folder, small, written

#: What separates words: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of more rows are not broadcast.
BROADCAST_ROWS = 1_000_000


def pieces(text: Column) -> Column:
    """The words in order, perhaps with an empty string before and after them."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(pieces(text), "")).cast("long")


def document_key(key: str, text: str) -> Column:
    """Rows that share key and text are the same document; null keys and repeated keys are allowed.

    Two hashes of 64 bits: two documents of ten thousand million share both with a chance under 1e-18.
    """
    return F.struct(F.xxhash64(F.lit(1), F.col(key), F.col(text)).alias("a"), F.xxhash64(F.lit(2), F.col(key), F.col(text)).alias("b"))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, copies, ipos, word, n): the words of each item by position, and their number.

    Rows that are equal in key and text are one item with so many ``copies``.
    """
    counted = items.groupBy(F.col(key).alias("item_id"), F.col(text).alias("text")).agg(F.count("*").cast("int").alias("copies"))
    return (
        counted.select(
            F.xxhash64("item_id", "text").alias("item"),
            "item_id",
            "copies",
            F.array_remove(pieces(F.col("text")), "").alias("words"),
        )
        .withColumn("n", F.size("words"))
        .select("item", "item_id", "copies", "n", F.posexplode("words").alias("ipos", "word"))
        .withColumn("word", ascii_lower(F.col("word")))
    )


def store_postings(docs: DataFrame, terms: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the postings (term, doc, pos) of all ``docs`` for the words in ``terms`` (term, word), a sorted segment for each task."""
    # the key in a step of its own, or it would be hashed from the whole text for each word
    split = docs.select(document_key(key, text).alias("doc"), pieces(F.col(text)).alias("words"))
    words = split.select("doc", F.posexplode("words").alias("pos", "word"))
    found = words.withColumn("word", ascii_lower(F.col("word"))).join(small(terms, BROADCAST_ROWS), "word")
    return written(found.select("term", "doc", "pos").sortWithinPartitions("term"), folder, "postings")


def numbered_terms(items: DataFrame, folder: str) -> DataFrame:
    """(term, word): the distinct words of the items, with a number hashed from each."""
    return written(items.select("word").distinct().withColumn("term", F.xxhash64("word")), folder, "terms")


def windows_by_rarest(items: DataFrame, frequency: DataFrame, size: int) -> DataFrame:
    """(item, n, p1, t1, p2, t2): positions and terms of the two rarest words of every window.

    Windows with a word that no document has are left out.
    """
    lists = (
        items.withColumn("term", F.xxhash64("word"))
        .join(frequency, "term", "left")
        .groupBy("item", "n")
        .agg(F.sort_array(F.collect_list(F.struct("ipos", F.coalesce("tf", F.lit(0)).alias("tf"), "term"))).alias("ws"))
    )
    long = F.least(F.col("n"), F.lit(size))
    starts = F.sequence(F.lit(1), F.col("n") - long + 1)
    ranked = F.transform(
        starts,
        lambda s: F.slice(F.sort_array(F.transform(F.slice("ws", s, long), lambda w: F.struct(w["tf"], w["ipos"], w["term"]))), 1, 2),
    )
    return (
        lists.select("item", "n", F.explode(ranked).alias("r"))
        .where("r[0].tf > 0")
        .select(
            "item",
            "n",
            F.col("r")[0]["ipos"].alias("p1"),
            F.col("r")[0]["term"].alias("t1"),
            F.coalesce(F.get("r", F.lit(1))["ipos"], F.col("r")[0]["ipos"]).alias("p2"),
            F.coalesce(F.get("r", F.lit(1))["term"], F.col("r")[0]["term"]).alias("t2"),
        )
        .distinct()
    )


def phrase_matches(postings: DataFrame, items: DataFrame, folder: str, size: int = 13) -> DataFrame:
    """(item, item_id, copies, doc, first, last): every run of document positions that matches the item.

    A run is as long as a window at least: ``size`` words, or the whole item if that is shorter.
    """
    frequency = postings.groupBy("term").agg(F.count("*").alias("tf"))
    windows = written(windows_by_rarest(items, frequency, size), folder, "windows")
    rarest = windows.select(F.col("t1").alias("term")).unionByName(windows.select(F.col("t2").alias("term"))).distinct()
    looked_up = written(postings.join(small(written(rarest, folder, "rarest"), BROADCAST_ROWS), "term", "left_semi"), folder, "looked_up")
    firsts = (
        looked_up.withColumnRenamed("term", "t1")
        .join(small(windows, BROADCAST_ROWS), "t1")  # beyond the bound AQE splits the rows of a frequent term
        .select("item", "n", "doc", (F.col("pos") - F.col("p1")).alias("shift"), "p2", "t2")
        .distinct()
    )
    aligned = (
        firsts.withColumn("pos", F.col("shift") + F.col("p2"))
        .join(looked_up.withColumnRenamed("term", "t2"), ["t2", "doc", "pos"], "left_semi")
        .select("item", "doc", "shift")
        .distinct()
    )
    aligned = written(aligned, folder, "aligned")
    hit_docs = small(written(aligned.select("doc").distinct(), folder, "aligned_docs"), BROADCAST_ROWS)
    wanted = aligned.join(small(written(items, folder, "items"), BROADCAST_ROWS), "item").select(
        "item", "item_id", "copies", "n", "doc", "shift", "ipos", (F.col("shift") + F.col("ipos")).alias("pos"), F.xxhash64("word").alias("term")
    )
    matched = wanted.join(
        postings.join(hit_docs, "doc", "left_semi").distinct(), ["doc", "pos", "term"], "left_semi"
    )
    order = Window.partitionBy("item", "doc", "shift").orderBy("ipos")
    return (
        matched.withColumn("island", F.col("ipos") - F.row_number().over(order))
        .groupBy("item", "item_id", "copies", "n", "doc", "shift", "island")
        .agg(F.count("*").alias("length"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        .where(F.col("length") >= F.least(F.col("n"), F.lit(size)))
        .select("item", "item_id", "copies", "doc", "first", "last")
    )


def proximity_matches(postings: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """(item, item_id, doc, first, last): a row for each place where all words of an item lie in ``within`` consecutive words.

    A place is a shortest one: no other place of the item lies inside it. It has an occurrence of the
    item's rarest word, near which its next rarest ones are looked for first, and around what that leaves
    all the others, in the stretches of ``within`` words next to it. A word that an item repeats counts
    once; a place may serve several items, and places may overlap. An item without words, or with a word
    that no document has, has no place; null texts have no words and so no place either.
    """
    folder = new_folder(postings.sparkSession, "proximity")
    frequency = postings.groupBy("term").agg(F.count("*").alias("tf"))
    words = items.select("item", "item_id", F.xxhash64("word").alias("term")).distinct().join(frequency, "term", "left")
    listed = words.groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("tf", F.lit(0)).alias("tf"), "term"))).alias("ws"))
    listed = listed.where(F.size("ws") <= within)  # more different words than that lie nowhere so near
    wanted = listed.where("ws[0].tf > 0").select("item", "item_id", F.transform("ws", lambda w: w["term"]).alias("terms"))
    wanted = written(wanted, folder, "wanted")
    # The places of each item's rarest words, in one scan; a place of the rarest stays if the next ones have one near it.
    rarest = wanted.select("item", F.posexplode(F.slice("terms", 1, RAREST)).alias("rank", "term"))
    rarest = small(written(rarest, folder, "rarest"), BROADCAST_ROWS)
    places = written(postings.join(rarest, "term").select("item", "rank", "doc", "pos").distinct(), folder, "places")
    cell = lambda pos: F.floor(F.col(pos) / within)
    anchors = places.where("rank = 0").select("item", "doc", F.col("pos").alias("anchor")).join(small(wanted, BROADCAST_ROWS // 16), "item")
    for rank in range(1, RAREST):
        other = places.where(F.col("rank") == rank).select("item", "doc", "pos", cell("pos").alias("cell"))
        around = anchors.where(F.size("terms") > rank).select("item", "doc", "anchor", F.explode(F.array(cell("anchor") - 1, cell("anchor"), cell("anchor") + 1)).alias("cell"))
        met = around.join(other.hint("merge"), ["item", "doc", "cell"]).where(F.abs(F.col("pos") - F.col("anchor")) < within).select("item", "doc", "anchor").distinct()
        kept = anchors.where(F.size("terms") > rank).join(met, ["item", "doc", "anchor"], "left_semi")
        anchors = kept.unionByName(anchors.where(F.size("terms") <= rank))
    anchors = written(anchors, folder, "anchors")
    there = small(written(anchors.select("doc").distinct(), folder, "anchored"), BROADCAST_ROWS)
    held = postings.join(there, "doc", "left_semi").distinct().withColumn("cell", cell("pos"))
    near = (
        anchors.select("item", "doc", "anchor", F.explode("terms").alias("term"))
        .withColumn("cell", F.explode(F.array(cell("anchor") - 1, cell("anchor"), cell("anchor") + 1)))
        .join(held.hint("merge"), ["doc", "term", "cell"])  # both sides grow with the corpus
        .where(F.abs(F.col("pos") - F.col("anchor")) < within)
        .groupBy("item", "doc", "anchor")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("at"))  # 2 * within at most
        .join(small(wanted, BROADCAST_ROWS // 16), "item")
        .where(F.size(F.array_distinct(F.transform("at", lambda b: b["term"]))) == F.size("terms"))
    )
    # From each start, the places where the words come first; the last of these ends the span.
    firsts = lambda a: F.transform(
        "terms", lambda t: F.array_min(F.transform(F.filter("at", lambda b: (b["pos"] >= a["pos"]) & (b["term"] == t)), lambda b: b["pos"]))
    )
    spans = F.transform("at", lambda a: F.struct(a["pos"].alias("first"), a["term"].alias("term"), firsts(a).alias("ends")))
    spans = F.transform(
        F.filter(spans, lambda s: ~F.exists(s["ends"], lambda e: e.isNull())), lambda s: F.struct(s["first"], s["term"], F.array_max(s["ends"]).alias("last"))
    )
    # shortest: the word at its start does not come again before its end
    again = lambda s: F.exists("at", lambda b: (b["term"] == s["term"]) & (b["pos"] > s["first"]) & (b["pos"] <= s["last"]))
    shortest = F.filter(spans, lambda s: (s["last"] - s["first"] < within) & ~again(s))
    return near.select("item", "item_id", "doc", F.explode(shortest).alias("span")).select("item", "item_id", "doc", "span.first", "span.last").distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    within: int | None = None,
) -> DataFrame:
    """(doc, n_hit, n_items, item_ids): documents with matches, the number of their words inside one, and the items.

    With ``within`` also ``n_near``, the number of items all of whose words lie within so many consecutive words,
    in whatever order; documents with such items alone are there then, with nulls before it.

    ``doc`` is ``document_key``. Null and empty texts have no words and no matches; null keys are
    keys like others; rows of equal key and text are one document here. Rows of the benchmark that are
    equal in key and text are so many items. An item without words has no window, and an empty
    benchmark matches nothing.
    """
    folder = new_folder(docs.sparkSession, "postings")
    items = written(item_terms(benchmark, item_key, item_text), folder, "item_terms")
    postings = store_postings(docs, numbered_terms(items, folder), folder, key, text)
    found = written(phrase_matches(postings, items, folder, size), folder, "matches")
    hits = (
        found.select("doc", F.explode(F.sequence("first", "last")).alias("pos"))
        .distinct()
        .groupBy("doc")
        .agg(F.count("*").alias("n_hit"))
    )
    which = (
        found.select("doc", "item", "copies", F.col("item_id").cast("string").alias("item_id"))
        .distinct()
        .groupBy("doc")
        .agg(F.sum("copies").alias("n_items"), F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(item_id, copies)")))).alias("item_ids"))
    )
    exact = hits.join(which, "doc")
    if within is not None:
        places = proximity_matches(postings, items, within).select("doc", "item").distinct().join(items.select("item", "copies").distinct(), "item")
        exact = exact.join(places.groupBy("doc").agg(F.sum("copies").alias("n_near")), "doc", "full")
    return written(exact, folder, "contamination")


#: So many of an item's rarest words are looked up before all others.
RAREST = 3
#: The query's distance for proximity matches: about twice an item's length.
NEAR_WORDS = 100


def is_contaminated(n_hit: Column, words: Column) -> Column:
    """At least one word in twenty lies inside a match."""
    return (n_hit > 0) & (20 * n_hit >= words)


def judged_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op8_positional_index``: how much of each document matches the benchmark, and how many items have all their words close together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), within=NEAR_WORDS)
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        docs.select("doc_id", document_key("doc_id", "text").alias("doc"), n_words(F.col("text")).alias("n_words"))
        .join(found, "doc", "left")
        .select(
            "doc_id",
            "n_words",
            hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"),
            is_contaminated(hit, F.col("n_words")).alias("contaminated"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names.

    Documents without words, and all where the benchmark is empty, stay; so do null ids, which are
    judged by their own text. Rows that are equal in id and text stay or go together.
    """
    found = contamination(docs, benchmark).select("doc", "n_hit")
    judged = docs.select(F.struct("*").alias("record"), document_key("doc_id", "text").alias("doc")).join(small(found, BROADCAST_ROWS), "doc", "left")
    gone = F.coalesce(is_contaminated(F.col("n_hit"), n_words(F.col("record.text"))), F.lit(False))
    return judged.where(~gone).select("record.*")


JUDGED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws
  FROM benchmark
), w AS (
  SELECT bid, item_id, len(ws) AS n, least(len(ws), 13) AS size, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM b WHERE len(ws) > 0
), win AS (SELECT bid, item_id, size, array_to_string(ws[s:s + size - 1], ' ') AS phrase FROM w),
sizes AS (SELECT DISTINCT size FROM win),
g AS (SELECT rid, size, ws, unnest(range(1, len(ws) - size + 2)) AS s FROM d, sizes WHERE len(ws) >= size),
hit AS (
  SELECT g.rid, g.s, g.size, win.bid, win.item_id FROM g JOIN win ON g.size = win.size AND array_to_string(g.ws[g.s:g.s + g.size - 1], ' ') = win.phrase
), pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS p FROM hit) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT rid, bid, item_id FROM hit) GROUP BY rid
), occ AS (
  SELECT dw.rid, bw.bid, dw.p, dw.word FROM (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d) dw
  JOIN (SELECT DISTINCT bid, unnest(ws) AS word FROM b) bw USING (word)
), whole AS (
  SELECT rid, bid, any_value(k) AS k FROM occ JOIN (SELECT bid, len(list_distinct(ws)) AS k FROM b) USING (bid) GROUP BY rid, bid HAVING count(DISTINCT word) = any_value(k)
), near AS (
  SELECT rid, count(DISTINCT bid) AS n_near FROM (
    SELECT x.rid, x.bid FROM occ x JOIN whole USING (rid, bid) JOIN occ y ON y.rid = x.rid AND y.bid = x.bid AND y.p BETWEEN x.p AND x.p + 99
    GROUP BY x.rid, x.bid, x.p HAVING count(DISTINCT y.word) = any_value(whole.k)
  ) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN near USING (rid) LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
