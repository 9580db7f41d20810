"""Each operator against a plain version, on documents with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterloom.llm import decontam, linededup, mixing, neardup, pii, quality, sharding, tokens, urlfilter, warc
from meterloom.llm.shared import first_positions, joined, new_folder, written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, record string, bucket int, node long, key string, n int, copy int, shard int, doc string"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals of the old dark forest every single day"


def near(text, k):
    words = text.split()
    words[k] = f"changed{k}"
    return " ".join(words)


def rows():
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    base = " ".join(f"w{i}" for i in range(120))
    texts = [
        (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, "one two"), (6, "ONE two"), (7, long), (8, "é É É. x"), (None, PROSE), (None, None), (9, "tie a b c d"), (9, "tie a b c d"),
        (10, base), (11, near(base, 3)), (12, near(near(base, 50), 90)), (13, near(near(near(base, 20), 40), 60)), (14, "line one is here\nshared line of text\nshared line of text\n\nend"),
        (15, "  Shared LINE of text\t\nother line\nshort"), (16, "a b c d e a b c d e f g h i j"), (17, "x" * 5000), (18, f"intro words {PROSE} and a tail"), (19, "\n\n"),
    ]
    return [(i, t, "en" if i else None, None if i == 5 else f"s{(i or 0) % 3}", 0, "r", 1, 2, "k", 3, 4, 5, "d") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(docs, none):
    got = quality.judge(docs).select("record.doc_id", "record.text", "quality", "base_failed", "kept").collect()
    assert len(got) == len(rows())
    for r in got:
        w = words(r["text"])
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        q = r["quality"]
        assert (q["words"]["n_words"], q["words"]["word_chars"], q["words"]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert q["lines"]["n_dup_lines"] == len(lines) - len(set(lines))
        assert q["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(none).count() == 0


def test_em_finds_the_better_rules():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    accuracy = (0.9, 0.85, 0.8, 0.55)
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in accuracy], axis=1) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    prior, rates = quality.fit_votes(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(prior - 0.8) < 0.05
    right = [r[1][0] / (r[1][0] + r[-1][0]) for r in rates]
    assert right[0] > right[3] and right[1] > right[3]
    judged = np.array([quality.posterior(tuple(v), prior, rates) >= 0.5 for v in votes.tolist()])
    assert (judged == truth).mean() > 0.9


def test_em_against_rows(spark):
    """Votes from the operator, and the fit over rows instead of over counts of patterns."""
    judged = quality.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("votes", "base_failed", "posterior", "kept").collect()
    votes = np.array([r["votes"] for r in judged])
    fitted = votes[[not r["base_failed"] for r in judged]]
    start = [[quality.START[v][kind] for v in (-1, 0, 1)] for kind in (1, 0)]
    prior, rates = 0.8, np.tile(start, (votes.shape[1], 1, 1))  # [rule][bad, good][vote + 1]
    start = rates.copy()
    chance = lambda v: 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(np.log(rates[r, 1, v[:, r] + 1] / rates[r, 0, v[:, r] + 1]) for r in range(v.shape[1])))))
    for _ in range(50):
        p = chance(fitted)
        for r in range(votes.shape[1]):
            for kind, weight in enumerate((1 - p, p)):
                for vote in (-1, 0, 1):
                    rates[r, kind, vote + 1] = quality.BELIEF * start[r, kind, vote + 1] + weight[fitted[:, r] == vote].sum()
                rates[r, kind] /= rates[r, kind].sum()
        prior = (p.sum() + 1) / (len(p) + 2)
    want = chance(votes)
    assert np.allclose([r["posterior"] for r in judged], want, atol=1e-9)
    assert [r["kept"] for r in judged] == [not r["base_failed"] and w >= 0.5 for r, w in zip(judged, want, strict=True)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_quality_on_labels(spark, sf):
    judged = quality.judged_documents(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    table = {(r["quality"], r["kept"]): r["count"] for r in judged.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert table.get((1, False), 0) <= 0.02 * table[(1, True)]
    assert table.get((0, True), 0) <= 0.15 * (table.get((0, False), 0) + table.get((0, True), 0))


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, size, percent):
    got = neardup.near_duplicates(docs, size=size, percent=percent).collect()
    assert len(got) == len(rows())
    sets = {r[0]: shingles(r[1], size) for r in rows() if r[0] is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) in ((1, False), (None, True))
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 300), (300, 400), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(frame, new_folder(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in (200, 300, 400))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [1, 2, 50_000, (1 << 32) - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    ids[3:4] = (1 << 32) - 1
    data, sizes = tokens.encode_blocks(ids)
    back = tokens.decode_blocks(data, np.concatenate([[0], np.cumsum(sizes)])[:-1])
    assert np.array_equal(back, ids)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_words_encode_as_texts():
    path, plain = tokenizer()
    texts = ["it's", "foo.'s bar", "a,b", "İstanbul x", "é ́a", "<|startoftext|> hi", "<|StartOfText|>.", None, "", "don't, I'll.", "ﬁ Ω", "x" * 3000, "12,5 3.14", "ẞ ß", "Aé.B", "k.́", "\x1c a\x85b", "foo!!bar é.É, ×. a×.b ÷;x ¿qué? don't! a's,b", "a<b>c|d", "ñ*** ñ%%%&&&", "ΣΑΣ. ΣΑΣ", "日本語。テスト", "한국 한", "x\u200by a_b a'b"]
    ids, counts = tokens.WordEncoder(path)(pa.array(texts), 1)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  Words, it's\n", None, "", "x.Y <|a|>"]
    ids, counts = tokens.WordEncoder(path)(pa.array(texts), 1)
    want = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_token_files_as_they_stand(spark):
    path, plain = tokenizer()
    texts = [(i * 7 % 30, f"text {i} of these") for i in range(30)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = tokens.encoded(frame, in_order=False).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]


def test_token_files(docs, none):
    path, plain = tokenizer()
    got = tokens.encoded(docs).collect()
    order = sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, start = [], 0
    for i, text in order:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.encoded(none).count() == 0


def test_mixing(docs, none, spark):
    got = mixing.mix_sources(docs).select("record.doc_id", "record.text", "copy", "position").collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert mixing.mix_sources(none).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ten bytes.").alias("text"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(many, {"big": 1.0, "small": 3.0}).groupBy("record.source").count().collect()}
    assert abs(counts["big"] - 5000) < 350 and abs(counts["small"] - 15_000) < 500
    one = spark.createDataFrame([(1, "a" * 9, "x"), (2, "b" * 100_000, "y")], "doc_id long, text string, source string")
    copies = mixing.mix_sources(one, {"x": 1.0, "y": 1e-9}).where("record.source = 'x'").count()
    assert abs(copies - 100_009 / 9) < 600  # a mean of some thousands is drawn in parts


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_contamination(docs, none, spark):
    bench = spark.createDataFrame([(1, PROSE), (2, "one two"), (3, ""), (4, None), (10, "Lazy dog, and RUNS far"), (10, "Lazy dog, and RUNS far"), (5, " ".join(f"w{i}" for i in range(40, 70)))], "item_id long, text string")
    found = {r["doc"]: r for r in decontam.contamination(docs, bench).collect()}
    keyed = docs.select("doc_id", "text", decontam.document_key("doc_id", "text").alias("k"), decontam.n_words(F.col("text")).alias("n")).collect()
    for r in keyed:
        w, hit, items = bench_words(r["text"]), set(), set()
        for row, b in enumerate(bench.collect()):
            v = bench_words(b["text"])
            size = min(13, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    items.add((str(b["item_id"]), row))
        f = found.get(r["k"])
        assert r["n"] == len(w)
        assert (f["n_hit"] if f else 0, f["item_ids"] if f else []) == (len(hit), sorted(i for i, _ in items))
        assert (f["n_items"] if f else 0) == len(items)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).count() == 0
    kept = decontam.without_contaminated(docs, bench)
    clashing = docs.withColumn("n_hit", F.lit(1)).withColumn("item", F.lit(1)).withColumn("gone", F.lit(1))
    assert sorted(r["doc_id"] or 0 for r in decontam.without_contaminated(clashing, bench).collect()) == sorted(r["doc_id"] or 0 for r in kept.collect())
    assert kept.columns == docs.columns and kept.where("doc_id = 18").count() == 0 and kept.where("doc_id = 16").count() == 1


def test_proximity(docs, spark):
    """Every shortest place of all words of an item, against all spans of each text."""
    texts = [PROSE, None, "", "a b x x a", "x a y b " * 3 + "z " * 40 + "b a", "a a b b a", "b"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = [(1, "fox dog"), (2, "animals fox"), (3, "A b"), (4, "b b"), (5, None), (6, "a missing"), (7, "x a b"), (7, "x a b")]
    items = decontam.item_terms(spark.createDataFrame(queries, "item_id long, text string"))
    folder = new_folder(spark, "t")
    postings = decontam.store_postings(table, decontam.numbered_terms(items, folder), folder)
    keys = {r["k"]: r["doc_id"] for r in table.select("doc_id", decontam.document_key("doc_id", "text").alias("k")).collect()}
    for within in (2, 4, 6):
        want = set()
        for doc, text in enumerate(texts):
            w = bench_words(text)
            for item, words_of in queries:
                need = set(bench_words(words_of))
                spans = {(i, j) for i in range(len(w)) for j in range(i, min(i + within, len(w))) if need and need <= set(w[i : j + 1])}
                want |= {(item, doc, i, j) for i, j in spans if not spans & {(i + 1, j), (i, j - 1)}}
        got = [(r["item_id"], keys[r["doc"]], r["first"], r["last"]) for r in decontam.proximity_matches(postings, items, within).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "https://com/en/1", "http://x.net/de/1#f", "http://a.example.net/de/81", "http://notcom/en/", "x://y://z.org/es/", "http://b.org/es", "http://q.org?/es/", "http://deep.sub.b.org/es/x"]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, record string, host string")
    place = {"verdict": "block", "host": "com", "path": "/en/", "place": -1}
    table = spark.createDataFrame([{**vars(r), "place": i} for i, r in enumerate(urlfilter.RULES)] + [place | {"verdict": "allow"}, place | {"host": None}])
    sharded = dict(shipped_bytes=0, shard_bytes=40)
    for judge in (urlfilter.filter_urls(pages), urlfilter.filter_urls(pages, table), urlfilter.filter_urls(pages, shard_bytes=40), urlfilter.filter_urls(pages, table, **sharded)):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge.select("record.page_id", "host", "path", "rule", "verdict").collect()}
        assert got[0] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
        assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
        assert got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == (None, "allow")
        assert got[8][:2] == ("y:", "//z.org/es/") and got[9][3] == "allow" and got[10][:2] == ("q.org", "") and got[11][3] == "block"
    assert urlfilter.filter_urls(pages.where("false")).count() == 0
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, (), "block").collect()} == {"block"}


def test_key_collision_decides_nothing():
    texts = [b"block\0org\0/es/", b"allow\0net\0/de/"]
    data = b"".join(np.array(x, k).tobytes() for x, k in (([2], "<u8"), ([7, 7], "<i8"), (np.cumsum([len(t) for t in texts]), "<u8"))) + b"".join(texts)
    rows = [("x.org", "/es/1", 3, 4), ("x.org", "/xx/1", 3, 4), ("net", "/de/", 3, 4), ("a.net", "/de", 3, 3)]
    tries = [[{"n": h + p, "h": h, "p": p, "key": 7}] for _, _, h, p in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(tries)], names=["host", "path", "tries"])
    found = urlfilter._best([(0, urlfilter.DigestArray(data))], batch, 1)
    assert [f and (f["rule"], f["verdict"]) for f in found] == [("org/es/", "block"), None, ("net/de/", "allow"), None]


def lines_left(records):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    key = lambda line: line.strip(strip).translate(LOWER)
    holders = {}
    for i, text in records:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add((i is None, i))
    out = []
    for i, text in records:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == (i is None, i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_lines(docs, none):
    want = sorted(lines_left([(r[0], r[1]) for r in rows()]), key=str)
    for n in (1, 3, 6):
        got = linededup.drop_repeated_lines(docs, n_batches=n).collect()
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got), key=str) == want
    assert linededup.drop_repeated_lines(none).count() == 0


def test_pseudonyms(docs, none, spark):
    text = "call +1 (437) 555-0689, 217.75.41.129 not 300.1.1.1; 2024-02-29 not 2023-02-30; 123-45-6789 4111-1111-1111-1111 not 4111111111111112 a.b@x.example.com."
    frame = spark.createDataFrame([(1, text), (2, "again 217.75.41.129 and 4111111111111111"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["record"]["doc_id"]: r for r in pii.pseudonymise(frame, "k").collect()}
    kinds = {f["kind"]: f["value"] for f in got[1]["found"]}
    assert set(kinds) == set(pii.KINDS)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", kinds["phone"]) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", kinds["date"]) and re.fullmatch(r"\d{4}(-\d{4}){3}", kinds["card"])
    assert all(x in got[1]["text"] for x in ("300.1.1.1", "2023-02-30", "4111111111111112")) and "217.75.41.129" not in got[1]["text"]
    again = {f["kind"]: f["value"] for f in got[2]["found"]}
    assert again["ip"] == kinds["ip"] and again["card"] == kinds["card"].replace("-", "")
    assert got[3]["text"] is None and got[4]["text"] == "" and got[3]["found"] == []
    forms = ["(212) 555-0123", "+44 20 7946 0958", "212-555-0123", "212.555.0123", "+1-212-555-0123", "+1 212 555 0123"]
    phones = spark.createDataFrame([(i, f"at {x}, or") for i, x in enumerate(forms)], "doc_id long, text string")
    made = {r["record"]["doc_id"]: r["found"] for r in pii.pseudonymise(phones, "k").collect()}
    blank = lambda x: re.sub(r"\d", "9", x)
    for i, form in enumerate(forms):
        assert [(f["kind"], blank(f["value"])) for f in made[i]] == [("phone", blank(form))]
        assert made[i][0]["value"] != form
    assert len({re.sub(r"\D", "", made[i][0]["value"])[-10:] for i in (0, 2, 3, 4, 5)}) == 1
    left = spark.createDataFrame([(1, "1.2.3 and 12-34 or 2024-13-40, 10.20.30 $1,234,567 0123456789")], "doc_id long, text string")
    assert pii.pseudonymise(left, "k").first()["found"] == []
    assert pii.pseudonymise(none, "k").count() == 0 and pii.pseudonymise(docs, "k").count() == len(rows())
    numbers = spark.range(300).select(F.format_string("%03d-%02d-%04d", F.col("id") % 100 + 1, F.col("id") % 7 + 1, F.col("id") + 1).alias("text"))
    made = [r["found"][0]["value"] for r in pii.pseudonymise(numbers, "k").collect()]
    assert len(set(made)) == 300 and not any(re.search("^(000|666|9)|-00-|-0000$", x) for x in made)
    for first, low, high in pii.DAYS[:2]:
        days = spark.range(first, first + low * high, 11).select(pii.permuted_day(F.col("id"), "q").alias("v"))
        assert days.distinct().count() == days.count() == days.where(F.col("v").between(first, first + low * high - 1)).count()
    assert sum(low * high for _, low, high in pii.DAYS) == 3_652_059
    digits = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "q").alias("v"))
    assert digits.distinct().count() == 1000


def test_lines_of_an_earlier_crawl(spark):
    """Runs are opened again: a later call drops what an earlier one has, with a smaller id or not."""
    folder = new_folder(spark, "t")
    crawls = [[(5, "a line of the first crawl\nanother of its lines"), (6, "a line of the first crawl")], [(1, "A line of the first crawl\nonly in the second"), (2, "only in the second")], [(3, "only in the second\nANOTHER of its lines\nnew at last")]]
    left = []
    for crawl in crawls:
        out = linededup.drop_repeated_lines(spark.createDataFrame(crawl, "doc_id long, text string"), n_batches=2, runs_folder=folder)
        left.append({r["doc_id"]: r["text"] for r in out.collect()})
    assert left == [{5: crawls[0][0][1], 6: ""}, {1: "only in the second", 2: ""}, {3: "new at last"}]


def feistel(value, low, high, key):
    a, b = divmod(value, high)
    for i in range(10):
        if i % 2 == 0:
            a = (a + keyed(key, i, high, b)) % low
        else:
            b = (b + keyed(key, i, low, a)) % high
    return a * high + b


def keyed(key, *parts):
    return int(hashlib.sha256(":".join([key, *map(str, parts)]).encode()).hexdigest()[:12], 16)


def digits_feistel(digits, key):
    n, left = len(digits), len(digits) // 2
    a, b = int(digits[:left]), int(digits[left:])
    for i in range(10):
        if i % 2 == 0:
            a = (a + keyed(key, i, n, b)) % 10**left
        else:
            b = (b + keyed(key, i, n, a)) % 10 ** (n - left)
    return f"{a:0{left}d}{b:0{n - left}d}"


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))


def refilled(form, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in form)


def plain_pseudonym(value, key):
    digits = re.sub("[^0-9]", "", value)
    if "@" in value:
        return "u" + hashlib.sha256(f"{key}:email:{value.lower()}".encode()).hexdigest()[:16] + "@" + value.rpartition("@")[2]
    if re.fullmatch(pii.PHONE, value):
        country = re.match(r"(?:\+[0-9]{1,3}(?![0-9]))?", value)[0]
        rest = value[len(country) :]
        return country + refilled(rest, digits_feistel(re.sub("[^0-9]", "", rest), key + ":phone"))
    if re.match(r"[0-9]+\.", value):
        parts = list(map(int, value.split(".")))
        if max(parts) > 255:
            return value
        v = feistel(int.from_bytes(bytes(parts)), 1 << 16, 1 << 16, key + ":ip")
        return ".".join(map(str, v.to_bytes(4)))
    if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
        try:
            day = date.fromisoformat(value).toordinal() - 1
        except ValueError:
            return value
        first, low, high = max(x for x in pii.DAYS if x[0] <= day)
        return date.fromordinal(1 + first + feistel(day - first, low, high, f"{key}:date:{first}")).isoformat()
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", value):
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return value
        areas = [a for a in range(1, 900) if a != 666]
        v = feistel((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key + ":ssn")
        return f"{areas[v // 9999 // 99]:03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"
    if luhn(digits) % 10:
        return value
    body = digits_feistel(digits[:-1], key + ":card")
    return refilled(value, body + str(-luhn(body + "0") % 10))


def test_pseudonyms_against_plain_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = ["3782-822463-10005 and 3782 822463 10005", "0001-01-01 1899-12-31 1900-01-01 2099-12-31 2100-01-01 9999-12-31 0000-05-05", "899-99-9999 667-01-0001 665-99-9999 001-01-0001"]
    table = table.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(more, 1)], "doc_id long, text string"))
    found = 0
    for r in pii.pseudonymise(table, "k").select("record", "text").collect():
        text = r["record"]["text"]
        assert r["text"] == (text and re.sub(pii.ANY, lambda m: plain_pseudonym(m[0], "k"), text))
        found += text is not None and r["text"] != text
    assert found > 10


def test_shards_of_repeated_rows(spark):
    """Rows that all repeat one key and text don't meet in one bucket."""
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x" * 92).alias("text"), "id")
    scattered, counts = sharding.placed_in_buckets(same, 100, 4000, 1, "doc_id", "text")
    assert counts.agg(F.max("n")).first()[0] < 400 and scattered.count() == 4000
    got = sharding.shuffle_into_shards(same, new_folder(spark, "t"), 7, bucket_bytes=4000).select("record.id", "shard", "slot").collect()
    assert sorted(r["id"] for r in got) == list(range(4000))
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s in range(7) for k in range(572 if s < 3 else 571)}


def test_sharded_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.sharded_documents(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)
    base, extra = divmod(len(texts), 24)
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(24) for k in range(base + (s < extra))]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    again = [r["doc_id"] for r in sorted(sharding.sharded_documents(spark, sf).collect(), key=lambda r: (r["shard"], r["slot"]))]
    assert order == again != sorted(texts)


def test_first_positions(spark):
    counts = spark.createDataFrame([(b * 3, b % 5) for b in range(200)], "bucket long, n long")
    got = {r["bucket"]: r["first"] for r in first_positions(counts, 16).collect()}
    assert got == {b * 3: sum(x % 5 for x in range(b)) for b in range(200)}


def test_joined_deals_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    table = written(rows.groupBy("k").agg(F.count("*").alias("n")).where("k != 4999"), new_folder(spark, "t"), "t")
    assert joined(rows, table, ["k"], "n").count() == 4999 and joined(rows, table, ["k"], "n", "left").where("n is null").count() == 1
    assert sorted(r["id"] for r in joined(rows, table, ["k"], "n", spread=4).collect()) == list(range(4999))


def test_shards(docs, none, spark):
    for n_shards, size in ((4, 1 << 20), (24, 20_000), (50, 50)):
        got = sharding.shuffle_into_shards(docs, new_folder(spark, "t"), n_shards, bucket_bytes=size)
        slots = {}
        for r in got.select("shard", "slot").collect():
            slots.setdefault(r["shard"], []).append(r["slot"])
        counts = [len(slots.get(i, [])) for i in range(n_shards)]
        assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
        key = lambda r: (str(r[0]), str(r[1]))
        assert sorted((tuple(r["record"])[:2] for r in got.select("record").collect()), key=key) == sorted((r[:2] for r in rows()), key=key)
    assert sharding.shuffle_into_shards(none, new_folder(spark, "t")).count() == 0


def test_archives(spark):
    page = "<p>" + "x" * 2000
    pages = [(1, "http://a/é%", page), (2, None, page), (3, "http://a", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "line\r\nbreak", "é" * 700), (None, "u", "none"), (9, "u", page)]
    frame = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, n_bytes int")
    index = warc.write_bundles(frame, new_folder(spark, "t"), frame_bytes=1500)
    got = sorted(map(tuple, warc.read_records(index).collect()), key=str)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        old = html == page and i != 9
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if old else "response", 9 if old else None))
    assert got == sorted(want, key=str)
    head = lambda url: warc.parse_record(warc.warc_record(1, url, "response", b"<p>", 3, "d", None))[0]
    assert head("http://a/x%20y?q=%C3")["WARC-Target-URI"] == "http://a/x%20y?q=%C3" and head("a b\té")["WARC-Target-URI"] == "a%20b%09%C3%A9"
    one = warc.read_records(index.where("page_id = 7")).collect()
    assert [tuple(r) for r in one] == [w for w in want if w[0] == 7]
    assert warc.write_bundles(frame.where("false"), new_folder(spark, "t")).count() == 0
