"""The stages of the pipeline, on rows with null ids, repeated ids and clashing columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meterloom.llm import mixing, neardup, quality
from meterloom.llm.shared import written

from .test_operators import PROSE, SCHEMA, docs, none, near, rows, shingles, tokenizer  # noqa: F401


def of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 0, "r", 1, 2, "k", 3, 4, 5, "d") for i, t in pairs], SCHEMA).repartition(3)


def left(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())


def test_near_duplicates_go_row_by_row(spark):
    base, other = (" ".join(f"{x}{i}" for i in range(120)) for x in "ab")
    pairs = [(1, PROSE), (None, PROSE), (None, "a clean text of no id"), (None, None), (None, None), (None, base), (None, near(base, 3)), (2, "repeated in id and text"), (2, "repeated in id and text"),
             (3, PROSE), (3, "another text of the same id"), (4, None), (4, None), (4, ""), (6, other), (5, near(other, 5))]
    got = corpus_pipeline.keep_one_of_each(spark, of(spark, pairs), "")
    assert got.columns == of(spark, []).columns
    found = left(got)
    assert found.pop((None, base), 0) + found.pop((None, near(base, 3)), 0) == 1
    want = [(1, PROSE), (None, "a clean text of no id"), (None, None), (2, "repeated in id and text"), (3, "another text of the same id"), (4, None), (4, ""), (5, near(other, 5))]
    assert found == Counter(want)


def test_near_duplicates_of_the_fixture(spark, docs, none):  # noqa: F811
    known = {i: t for i, t, *_ in rows() if i is not None}
    sets = {i: shingles(t, 5) for i, t in known.items()}
    group = {i: i for i in sets}
    for _ in sets:  # the smallest id goes along the links
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[i] = min(group[i], group[j])
    want = Counter({(i, t): 1 for i, t in known.items() if group[i] == i} | {(None, None): 1})
    assert left(corpus_pipeline.keep_one_of_each(spark, docs, "")) == want
    assert corpus_pipeline.keep_one_of_each(spark, none, "").count() == 0


def test_run_against_a_plain_version(spark, tmp_path):
    """run() on rows with nulls, ties, empty and long texts and clashing names; the fit's own numbers are tested elsewhere."""
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(n))
    texts = [prose(6) for _ in range(60)]
    item = " ".join(rng.choice(vocabulary) for _ in range(20))
    pairs = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (None, texts[4]), (None, texts[5] + " tail"), (101, None), (102, ""), (103, "too short"), (104, f"{prose(2)} {item} {prose(1)}")]
    pairs += [(105, prose(400)), (106, prose(1) * 9), (107, texts[7]), (107, texts[7]), (108, f"# $ % {'& | ' * 40}")]
    of(spark, pairs).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {(r["id"], r["text"]) for r in quality.judge(docs).where("kept").selectExpr("record.doc_id as id", "record.text as text").collect()}
    assert not kept & {(101, None), (102, ""), (103, "too short"), pairs[-1]} and not any(i == 106 for i, _ in kept)
    assert {(i, t) for i, t in enumerate(texts)} <= kept
    ranked = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    chosen = []
    for i, t in ranked:  # in this fixture every group of near copies has the first for its centre
        x = shingles(t, 5)
        if not any(100 * len(x & y) >= 80 * len(x | y) for y in (shingles(u, 5) for _, u in chosen)):
            chosen.append((i, t))
    left = {(i, t) for i, t in chosen if i != 104}
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.mix_sources(spark.createDataFrame([(i, t, "a" if i is not None and i % 3 == 0 else "b") for i, t in left], "doc_id long, text string, source string")).select("record.*").collect())
    path, plain = tokenizer()
    want = Counter()
    for (i, t), n in mixed.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += n
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    starts = np.cumsum([0, *(r["n_tokens"] for r in rows)])
    assert [r["start"] for r in rows] == starts[:-1].tolist()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids != sorted(ids)  # mixing's order is the files'


def test_stages_of_nothing_and_of_clashing_names(spark, none, docs, tmp_path):  # noqa: F811
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs.withColumns({c: F.lit(1) for c in ("n_hit", "doc", "own", "gone", "gone_id", "quality", "votes", "kept", "node", "cluster", "position", "mix_source", "bucket", "id", "hashed")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        assert name == "token ids" or got.columns == odd.columns
        got.collect()


def template(n, changed, words=200, seed=1):
    """Pages of one template, each with some words of its own."""
    rng, pages = random.Random(seed), []
    for page in range(n):
        text = [f"t{i}" for i in range(words)]
        for k in rng.sample(range(words), changed):
            text[k] = f"own{page}_{k}"
        pages.append(" ".join(text))
    return pages


def smallest_ids(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(sets))}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_templates_make_few_pairs_and_lose_none(spark, monkeypatch, size, percent):
    """Pages of a template that do not link make no more pairs than there are pages; all links of mixed ones are found."""
    made = {}

    def recorded(frame, folder, name):
        made[name] = written(frame, folder, name)
        return made[name]

    monkeypatch.setattr(neardup, "written", recorded)
    groups = lambda texts: {
        r["doc_id"]: r["component_id"]
        for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=size, percent=percent).collect()
    }
    for n in (400, 800):
        pages = template(n, 5)
        got = groups(pages)
        assert made["pairs-1"].count() + made["pairs-2"].count() <= n
        if n == 400:
            assert got == smallest_ids(pages, size, percent)
    rng = random.Random(3)
    mixed = [t for c in range(2, 7) for t in template(40, c, 120, c)] + template(60, 2, 90, 9) + template(60, 4, 150, 10)
    mixed += [" ".join(f"t{rng.randrange(12)}" for _ in range(rng.randrange(5, 60))) for _ in range(100)]
    assert groups(mixed) == smallest_ids(mixed, size, percent)
