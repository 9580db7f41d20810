"""Divergence audit, attention over passages and periodic runs against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import attention, divergence, periodic

from .test_operators import SCHEMA, docs, none, rows, words  # noqa: F401


def plain_runs(w, least=24, times=3):
    """All runs by trying every period on every word."""
    codes = {x: i for i, x in enumerate(dict.fromkeys(w))}
    x, runs = np.array([codes[k] for k in w], int), {}
    for q in range(1, len(x) // times + 1):
        edges = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]]))
        for begin, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            length = end - begin + q
            if length >= max(least, times * q):
                runs.setdefault((begin, length), q)  # the smallest period comes first
    return sorted(((s, n, q) for (s, n), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_transform():
    rng = np.random.default_rng(2)
    for size in (8, 32, 256):
        top = 1 << periodic._value_bits(size)
        blocks, windows = rng.integers(0, top, (size, 4)), rng.integers(0, top, (2 * size, 4))
        blocks[:, 1], windows[:, 1] = top - 1, 0  # the largest sum there is
        got = periodic.squared_differences(blocks, windows)
        want = [((blocks - windows[t : t + size]) ** 2).sum(axis=0) for t in range(size + 1)]
        assert (got == np.array(want)).all()
        assert (periodic.inverse(periodic.transform(windows)) == windows).all()


def test_runs_in_sequences():
    """Random words, planted periods, words of Fibonacci and Thue-Morse, and one word throughout."""
    rng = np.random.default_rng(3)
    cases = [np.zeros(500, int), np.array([i.bit_count() & 1 for i in range(1024)]), np.tile(np.append(np.zeros(100, int), 1), 9), np.tile(np.append(np.tile(np.append(np.zeros(40, int), 1), 5), 2), 4)]
    a, b = "a", "b"
    while len(a) < 900:
        a, b = a + b, a
    cases.append(np.array([ord(c) for c in a]))
    for k in (1, 2, 3, 40, 500) * 40:
        x = rng.integers(0, k, int(rng.integers(0, 400)))
        for _ in range(rng.integers(0, 4)):
            if len(x) > 30:
                begin = int(rng.integers(0, len(x)))
                period = 1 + (len(x) - begin) // int(rng.choice([3, 4, 9, 30]))
                for i in range(begin + period, int(rng.integers(begin, len(x) + 1))):
                    x[i] = x[i - period]
        cases.append(x)
    for x in cases:
        assert [tuple(r) for r in periodic.find_runs(x.astype(np.int64)).tolist()] == plain_runs(x.tolist())
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(100, np.int64), least=10)


def test_equal_values_of_unequal_words_make_no_run(monkeypatch):
    """Values and hashes that tell nothing apart: what is found still holds on the words themselves."""
    x = np.array(([1, 2, 3, 4, 5, 6, 7] * 20) + list(range(50, 90)) + [8, 9] * 15)
    monkeypatch.setattr(periodic, "_value_bits", lambda size: 1)
    monkeypatch.setattr(periodic._Extents, "_agree", lambda self, start, size, d: np.ones(len(start), bool))
    assert [tuple(r) for r in periodic.find_runs(x).tolist()] == plain_runs(x.tolist())


def test_periodic_runs(spark, docs, none):  # noqa: F811
    loop = " ".join(f"t{i % 7}" for i in range(60))
    more = [(50, loop), (51, "head " + loop.replace(" ", "\n\t ") + " tail"), (None, loop), (50, loop), (52, " ".join(["x"] * 24)), (53, " ".join(["x"] * 23)), (54, "é " * 30)]
    every = rows() + [(i, t, "en", "s", 0, "r", 1, 2, "k", 3, 4, 5, "d") for i, t in more]
    frame = spark.createDataFrame(every, SCHEMA).repartition(3)
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic.periodic_runs(frame).collect())
    want = Counter()
    for i, text, *_ in every:
        w = words(text)
        runs = plain_runs(w)
        want[i, len(w), tuple(runs), collapsed(w, runs)] += 1
    assert got == want
    assert periodic.periodic_runs(none).count() == 0


def test_collapsed_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = periodic.collapsed_documents(spark, sf).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) > len(texts) // 20
    for r in got:
        w = planted(r["doc_id"], words(texts[r["doc_id"]]))
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) == (len(runs), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)


def plain_audit(every, least, smoothing=5, top=50):
    """(lang, source, text) -> the rows of the audit, each pair over each term."""
    groups, lists, docs = {}, {}, Counter()
    for lang, source, text in every:
        lang, source = lang or "", source or ""
        found = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.setdefault(lang, set()).add(source)
        lists.setdefault((lang, source), Counter()).update(found)
        docs.update({(lang, t) for t in found})
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for x, t in docs if x == lang and docs[x, t] >= least)
        counts = {s: {t: lists[lang, s][t] for t in kept} for s in sources}
        counts[None] = {t: sum(lists[lang, s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + smoothing) // (sum(own.values()) + smoothing * len(kept)) for t, c in own.items()} for s, own in counts.items()}
        for s in sources:
            pairs = [(other, sum(abs(p[s][t] - p[other][t]) for t in kept)) for other in sources if other != s]
            terms = [(t, p[s][t] - p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return Counter(out)


def test_divergence(spark, docs, none):  # noqa: F811
    rng = np.random.default_rng(4)
    every = [(r[2], r[3], r[1]) for r in rows()]
    vocabulary = [f"{a}{b}" for a in ("Ab", "ab", "é", "É", "x_", "zz1") for b in "abcdefghijk"] + ["\0", "1 2", "[\\]^`{|}~"]
    for i in range(400):
        picked = rng.choice(vocabulary, size=int(rng.integers(0, 30)), p=np.arange(len(vocabulary), 0, -1) / (len(vocabulary) * (len(vocabulary) + 1) / 2))
        every.append((("en", "fr", None, "")[i % 4], ("hot", "b", None, "é", "Z", "a")[min(int(rng.integers(0, 9)), 5)], rng.choice([" ", "\n", "-9-"]).join(picked)))
    every += [("rare", "only", "seldom words"), ("rare", "other", None), ("lone", "one", "word")] * 2
    frame = spark.createDataFrame([(i, t, lang, s, 0, "r", 1, 2, "k", 3, 4, 5, "d") for i, (lang, s, t) in enumerate(every)], SCHEMA).repartition(3)
    for least in (1, 4):
        got = Counter(tuple(r) for r in divergence.divergence_audit(frame, least=least, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == plain_audit(every, least, top=7)
    assert divergence.divergence_audit(none).count() == 0


def test_divergence_of_many_groups(spark, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(divergence, "FEW_GROUPS", 1)
    got = Counter(tuple(r) for r in divergence.divergence_audit(docs, least=1).collect())
    assert got == plain_audit([(r[2], r[3], r[1]) for r in rows()], 1)


def plain_features(w):
    """The features of one passage, word by word."""
    n, out = max(len(w), 1), np.zeros(attention.N_FEATURES)
    kinds = [str.isalpha, str.isupper, lambda c: c.isnumeric(), "#*$%&|<>".__contains__, "!".__contains__]
    for x in w:
        out[zlib.crc32(x.encode()) % attention.BUCKETS] += 1 / n
        for k, kind in enumerate(kinds):
            out[attention.BUCKETS + k] += sum(map(kind, x)) / len(x) / n
        out[attention.BUCKETS + 5] += bool(re.search("[.!?…]$", x)) / n
        out[attention.BUCKETS + 6] += (not any(c.isalpha() or c.isnumeric() for c in x)) / n
        out[attention.BUCKETS + 7] += np.log1p(len(x)) / n
    out[-4:] = len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, np.log1p(len(w)), not w
    return out


def plain_score(model, text, size=64):
    w = words(text)
    codes, logits = [], []
    for k in range(0, max(len(w), 1), size):
        h = np.maximum((plain_features(w[k : k + size]) - model["mean"]) / model["spread"] @ model["W"] + model["b"], 0)
        codes.append(h)
        logits.append((np.tanh(h @ model["V"]) / (1 + np.exp(-(h @ model["U"])))) @ model["w"])
    weight = np.exp(np.array(logits) - max(logits))
    weight /= weight.sum()
    return 1 / (1 + np.exp(-(weight @ np.array(codes) @ model["c"] + model["d"][0]))), int(np.argmax(weight)), weight.max()


def test_gradients():
    """Against differences of the loss, for every kind of weight."""
    rng = np.random.default_rng(5)
    model = attention.new_model(attention.Settings(hidden=5, gates=3))
    features, bag, labels = rng.random((9, attention.N_FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    _, gradients = attention.loss_and_gradients(model, features, bag, labels, 0.01)
    for name, gradient in gradients.items():
        for _ in range(6):
            at = tuple(rng.integers(0, k) for k in gradient.shape)
            ends = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in model.items()}
                moved[name][at] += step
                ends.append(attention.loss_and_gradients(moved, features, bag, labels, 0.01)[0])
            assert abs((ends[0] - ends[1]) / 2e-6 - gradient[at]) < 1e-6, name


def test_scores(spark, docs, none, monkeypatch):  # noqa: F811
    """Each row by its own whole text, passages in several blocks, against one passage at a time."""
    monkeypatch.setattr(attention, "BLOCK", 100)
    rng = np.random.default_rng(6)
    model = attention.new_model(attention.Settings()) | {"mean": rng.random(attention.N_FEATURES), "b": rng.random(32)}
    got = Counter((r["doc_id"], round(r["score"], 9), r["n_passages"], r["top_passage"], round(r["top_weight"], 9)) for r in attention.score_documents(docs, model).collect())
    want = Counter()
    for i, text, *_ in rows():
        score, top, weight = plain_score(model, text)
        want[i, round(score, 9), max(1, -(-len(words(text)) // 64)), top, round(weight, 9)] += 1
    assert got == want
    assert attention.score_documents(none, model).count() == 0


def test_fit(spark, docs, none):  # noqa: F811
    """What is learned: no null labels or ids, a mean of several labels, the sample's bound, and nothing without both labels."""
    labels = lambda pairs: spark.createDataFrame(pairs, "doc_id long, quality int, text string")
    few = attention.Settings(sample=5, bag=2, epochs=2)
    same = attention.fit_classifier(docs, labels([(1, 1, "x"), (2, 1, "x"), (None, 0, "x"), (3, None, "x"), (99, 0, "x")]), few)
    assert not same["c"].any() and abs(same["d"][0] - np.log(3)) < 1e-12  # two labels, both 1
    again = [attention.fit_classifier(docs, labels([(i, i % 2, "x") for i in range(1, 20)] + [(7, 0, "x"), (7, 0, "x")]), few) for _ in range(2)]
    assert all((again[0][k] == again[1][k]).all() for k in again[0]) and again[0]["c"].any()
    assert not attention.fit_classifier(none, labels([]), few)["c"].any()
    assert not attention.fit_classifier(docs, labels([]), few)["c"].any()


def test_held_out_accuracy(spark):
    """On the fifth of the labels that was not learned from."""
    sf = "/root/testdata/sf0.01"
    scored = attention.classified_documents(spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    judged = scored.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(judged) > 50 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in judged)
    assert np.mean([r["predicted"] == r["quality"] for r in judged]) > 0.95
