"""A quality classifier over passages: multiple-instance learning with gated attention.

A text is a bag of passages of consecutive words, and only the bag has a label. Each passage is
encoded by a learned layer over its features, gated attention weighs the passages of a bag, and the
weighted mean of their codes is scored. All weights are learned together, in numpy on the driver,
from a sample of labelled documents of bounded size; scoring is a map over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .periodic import _words
from .shared import slices

#: What is counted in each word, as patterns.
COUNTED = (r"\p{L}", r"\p{Lu}", r"\p{N}", r"[#*$%&|<>]", "!", r"[.!?…]$", r"^[^\p{L}\p{N}]+$")
BUCKETS = 48
N_FEATURES = BUCKETS + len(COUNTED) + 5
#: Passages whose features are in memory at once.
BLOCK = 1 << 13


@dataclass(frozen=True)
class Settings:
    """``size`` words make a passage. At most ``sample`` labelled documents, and of each at most ``bag`` passages, evenly apart, are learned from."""

    size: int = 64
    sample: int = 4000
    bag: int = 32
    hidden: int = 32
    gates: int = 16
    epochs: int = 15
    batch: int = 128
    rate: float = 0.005
    decay: float = 1e-4
    seed: int = 7


def _passages(texts, size: int):
    """Of the texts' passages: (row of the text, first word, words); a text without words has one empty passage."""
    import numpy as np

    words, starts = _words(texts)
    n_words = np.diff(starts)
    n_passages = np.maximum(-(-n_words // size), 1)
    row = np.repeat(np.arange(len(texts)), n_passages)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
    first = starts[row] + place * size
    return words, row, place, first, np.minimum(n_words[row] - place * size, size)


class _Features:
    """The features of passages of a batch's words: what is counted by word is counted once for each different word."""

    def __init__(self, words) -> None:
        import zlib

        import numpy as np
        import pyarrow.compute as pc

        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = coded.dictionary
        whole = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.float64)
        counted = [pc.count_substring_regex(own, p).to_numpy(zero_copy_only=False).astype(np.float64) for p in COUNTED]
        # Shares of the word's letters or signs; the last two are yes or no.
        shares = [c / whole for c in counted[:-2]] + counted[-2:]
        self.by_word = np.column_stack([*shares, np.log1p(whole)]) if len(own) else np.empty((0, len(COUNTED) + 1))
        self.bucket = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in own.to_pylist()), np.int64, len(own))

    def of(self, first, size):
        """A row for each passage of ``size`` words from ``first`` on."""
        import numpy as np

        n = len(first)
        passage = np.repeat(np.arange(n), size)
        at = np.arange(len(passage)) - np.repeat(np.cumsum(size) - size, size)
        code = self.code[first[passage] + at]
        out = np.zeros((n, N_FEATURES))
        each = np.maximum(size, 1)
        out[:, :BUCKETS] = np.bincount(passage * BUCKETS + self.bucket[code], minlength=n * BUCKETS).reshape(n, BUCKETS) / each[:, None]
        for k in range(self.by_word.shape[1]):
            out[:, BUCKETS + k] = np.bincount(passage, self.by_word[code, k], n) / each
        distinct = np.unique(passage * (len(self.bucket) + 1) + code) // (len(self.bucket) + 1)
        doubled = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
        out[:, -4] = np.bincount(distinct, minlength=n) / each
        out[:, -3] = np.bincount(passage[1:][doubled], minlength=n) / each
        out[:, -2] = np.log1p(size)
        out[:, -1] = size == 0
        return out


def _sampler(settings: dict):
    """A row for each text: a checksum of it, and its passages' features as bytes."""

    def sample(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole, "text")):
            words, row, place, first, size = _passages(batch["text"], settings["size"])
            n_passages = np.bincount(row, minlength=batch.num_rows)
            most = settings["bag"]
            # Passage k is taken where k * most // n steps up, so at most that many, evenly apart.
            taken = (n_passages[row] <= most) | ((place + 1) * most // n_passages[row] > place * most // n_passages[row])
            features = _Features(words).of(first[taken], size[taken]).astype(np.float32)
            cuts = np.searchsorted(row[taken], np.arange(batch.num_rows + 1))
            bags = [features[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            sums = [zlib.crc32((t or "").encode()) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(sums, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "label", "crc", "bag"])

    return sample


def _sigmoid(x):
    import numpy as np

    return 0.5 * (1 + np.tanh(0.5 * x))


def encode(model: dict, features):
    """Codes of passages, and their logits of attention before the softmax over a bag."""
    import numpy as np

    hidden = np.maximum((features - model["mean"]) / model["spread"] @ model["W"] + model["b"], 0)
    return hidden, (np.tanh(hidden @ model["V"]) * _sigmoid(hidden @ model["U"])) @ model["w"]


def loss_and_gradients(model: dict, features, bag, labels, decay: float):
    """Mean cross entropy of bags, ``bag`` being the number of each passage's bag in ascending order, and its gradients."""
    import numpy as np

    n = len(labels)
    scaled = (features - model["mean"]) / model["spread"]
    hidden = np.maximum(scaled @ model["W"] + model["b"], 0)
    t, s = np.tanh(hidden @ model["V"]), _sigmoid(hidden @ model["U"])
    starts = np.searchsorted(bag, np.arange(n))
    weight = np.exp((t * s) @ model["w"])
    weight = weight / np.add.reduceat(weight, starts)[bag]
    z = np.add.reduceat(weight[:, None] * hidden, starts)
    logit = z @ model["c"] + model["d"][0]
    trained = ("W", "b", "V", "U", "w", "c")
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit) + decay / 2 * sum((model[k] ** 2).sum() for k in trained))
    d_logit = (_sigmoid(logit) - labels) / n
    d_z = d_logit[:, None] * model["c"]
    inner = (hidden * d_z[bag]).sum(axis=1)
    d_e = weight * (inner - np.add.reduceat(weight * inner, starts)[bag])
    d_t, d_s = d_e[:, None] * model["w"] * s * (1 - t * t), d_e[:, None] * model["w"] * t * s * (1 - s)
    d_hidden = (weight[:, None] * d_z[bag] + d_t @ model["V"].T + d_s @ model["U"].T) * (hidden > 0)
    gradients = {"W": scaled.T @ d_hidden, "b": d_hidden.sum(axis=0), "V": hidden.T @ d_t, "U": hidden.T @ d_s, "w": (t * s).T @ d_e, "c": z.T @ d_logit}
    gradients = {k: g + decay * model[k] for k, g in gradients.items()} | {"d": np.array([d_logit.sum()])}
    return loss, gradients


def new_model(settings: Settings) -> dict:
    """Weights to begin with, drawn from the seed."""
    import numpy as np

    rng = np.random.default_rng(settings.seed)
    draw = lambda *shape: rng.normal(size=shape) / math.sqrt(shape[0])
    f, h, g = N_FEATURES, settings.hidden, settings.gates
    return {"mean": np.zeros(f), "spread": np.ones(f), "W": draw(f, h), "b": np.zeros(h), "V": draw(h, g), "U": draw(h, g), "w": draw(g), "c": draw(h), "d": np.zeros(1)}


def train(bags: list, labels: list, settings: Settings) -> dict:
    """Adam over minibatches of bags (a matrix of passages' features each). Without both labels, every score is the labels' smoothed mean."""
    import numpy as np

    model, y = new_model(settings), np.array(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    model["d"] = np.array([math.log(share / (1 - share))])
    if not len(y) or y.min() == y.max():
        return model | {"c": np.zeros(settings.hidden)}
    every = np.concatenate(bags).astype(float)
    model["mean"], model["spread"] = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    ends = np.cumsum([len(b) for b in bags])
    rng, step = np.random.default_rng(settings.seed + 1), 0
    trained = [k for k in model if k not in ("mean", "spread")]
    first, second = ({k: np.zeros_like(model[k]) for k in trained} for _ in range(2))
    for _ in range(settings.epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), settings.batch):
            own, step = order[i : i + settings.batch], step + 1
            rows = np.concatenate([np.arange(ends[b] - len(bags[b]), ends[b]) for b in own])
            bag = np.repeat(np.arange(len(own)), [len(bags[b]) for b in own])
            _, gradients = loss_and_gradients(model, every[rows], bag, y[own], settings.decay)
            for k in trained:
                first[k] = 0.9 * first[k] + 0.1 * gradients[k]
                second[k] = 0.999 * second[k] + 0.001 * gradients[k] ** 2
                model[k] = model[k] - settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_classifier(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """The model learned from documents that ``labels`` (key, label of 0 or 1) names: those ``settings.sample`` whose ids have the smallest hashes.

    Null labels and ids teach nothing; an id with several labels has their rounded mean (a half is 0), and an
    id with several texts is learned from the one of the smallest checksum. Sent to the driver: ``sample`` bags
    of ``bag`` passages at most, whatever the size of the tables.
    """
    import numpy as np

    named = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    named = named.groupBy("doc_id").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    there = named.join(docs.select(F.col(key).alias("doc_id")), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    kind = texts.schema["doc_id"].dataType.simpleString()
    bags = texts.mapInArrow(_sampler({"size": settings.size, "bag": settings.bag}), f"doc_id {kind}, label int, crc long, bag binary")
    rows = sorted(bags.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("bag", "crc").alias("bag")).collect(), key=lambda r: r["doc_id"])
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows], [r["label"] for r in rows], settings)


def _scorer(model: dict, size: int):
    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (part for whole in batches for part in slices(whole, "text")):
            words, row, place, first, n_words = _passages(batch["text"], size)
            features, n = _Features(words), batch.num_rows
            total, mixed = np.zeros(n), np.zeros((n, len(model["c"])))
            best, at = np.full(n, -np.inf), np.zeros(n, np.int64)
            for i in range(0, len(row), BLOCK):
                own = slice(i, i + BLOCK)
                hidden, logit = encode(model, features.of(first[own], n_words[own]))
                weight = np.exp(logit)  # logits are as small as the sum of the gates' weights
                np.add.at(total, row[own], weight)
                np.add.at(mixed, row[own], weight[:, None] * hidden)
                by = np.lexsort((place[own], -logit, row[own]))
                top = by[np.r_[True, np.diff(row[own][by]) > 0]]
                better = logit[top] > best[row[own][top]]
                best[row[own][top][better]], at[row[own][top][better]] = logit[top][better], place[own][top][better]
            scores = _sigmoid(mixed / total[:, None] @ model["c"] + model["d"][0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(scores), pa.array(np.bincount(row, minlength=n)), pa.array(at), pa.array(np.exp(best) / total)],
                names=[*batch.schema.names[:-1], "score", "n_passages", "top_passage", "top_weight"],
            )

    return score


def score_documents(docs: DataFrame, model: dict, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, top_passage, top_weight) for each row of ``docs``, from all passages of its text alone.

    ``top_passage`` is the number of the passage with the most attention (the first of equal ones). Null and
    empty texts are one empty passage. Equal texts get equal scores up to rounding; an empty table gives no rows.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_scorer(model, settings.size), f"doc_id {kind}, score double, n_passages long, top_passage long, top_weight double")


def held_out(key: str = "doc_id"):
    """Whether an id is in the fifth that is not learned from; a null id is not, as no label can name it."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classified_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op12_attention_passages``: every document's score, learned from labels outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())
    scored = score_documents(docs, fit_classifier(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")
