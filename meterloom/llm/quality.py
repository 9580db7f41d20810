"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Votes are counted by pattern, which there are
at most 3 ** rules of; expectation-maximisation over those counts estimates how each rule votes on
good and on bad documents, and a document is kept if its posterior probability of being good is
high enough. No labels are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import new_folder, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: A word without letters and digits, as between the entries of menus.
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
WINDOW = 5
#: The probabilities of each vote on good and on bad documents to begin with, and the weight of that in documents.
START = {1: (0.75, 0.45), -1: (0.02, 0.3), 0: (0.23, 0.25)}
BELIEF = 5.0


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """The number of words in 5-word windows found twice or more in the array."""

    def covered(keys: Column) -> Column:
        # Equal windows stand side by side once sorted; the window itself is the key.
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        repeated = _let(
            ordered,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        x["k"].eqNullSafe(F.get(s, j - 1)["k"]) | x["k"].eqNullSafe(F.get(s, j + 1)["k"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        return _let(
            F.sort_array(repeated),
            lambda p: F.aggregate(
                F.transform(p, lambda i, j: F.least(F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0),
                lambda total, step: total + step,
            ),
        )

    def windows(key) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
        return F.transform(starts, lambda i: key(*[F.get(words, i + k) for k in range(WINDOW)]))

    # Most texts repeat no window, which hashes show: equal windows have equal hashes.
    repeats = _let(windows(F.xxhash64), lambda hashes: F.size(F.array_distinct(hashes)) < F.size(hashes))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).when(
        repeats, _let(windows(lambda *parts: F.concat_ws(" ", *parts)), covered)
    ).otherwise(F.lit(0))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``quality`` of counts over the whole text; a null text counts as empty.

    The struct comes out of a generator, so that Spark doesn't compute it anew for each use.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, BLANK), "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    length = F.char_length(body)
    counts = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long").alias("n_doubled"),
        ),
    )
    line_counts = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda line: line.rlike(r"""[.!?…"')\]][\x20\x09-\x0D]*$"""))).cast("long").alias("n_ended"),
        ),
    )
    gone = lambda pattern: (length - F.char_length(F.regexp_replace(body, pattern, ""))).cast("long")
    features = F.struct(
        counts.alias("words"),
        line_counts.alias("lines"),
        gone(SYMBOLS).alias("n_symbols"),
        gone(r"\p{Lu}+").alias("n_upper"),
        gone("!+").alias("n_shouts"),
        gone(r"\p{L}+").alias("n_letters"),
        gone(r"[\p{L}\p{N}]+").alias("n_alphanumeric"),
        F.regexp_count(body, F.lit(BARE)).cast("long").alias("n_bare"),
    )
    return docs.select("*", F.explode(F.array(features)).alias("quality"))


@dataclass(frozen=True)
class Rule:
    """Bad from ``bad`` on and good up to ``good``, in the direction in which larger values are worse."""

    name: str
    value: object
    good: float
    bad: float

    def vote(self) -> Column:
        value = self.value()
        return F.when(value >= self.bad, -1).when(value <= self.good, 1).otherwise(0).cast("int")


def _ratio(over: str, under: str):
    return lambda: F.try_divide(F.col(f"quality.{over}"), F.col(f"quality.{under}"))


RULES = (
    Rule("symbols", _ratio("n_symbols", "words.word_chars"), 0.02, 0.08),
    Rule("bare_words", _ratio("n_bare", "words.n_words"), 0.03, 0.15),
    Rule("shouting", _ratio("n_shouts", "words.n_words"), 0.1, 0.5),
    Rule("capitals", _ratio("n_upper", "n_letters"), 0.15, 0.5),
    Rule("alphanumeric", lambda: -F.try_divide(F.col("quality.n_alphanumeric"), F.col("quality.words.word_chars")), -0.85, -0.7),
    Rule("repetition", _ratio("words.n_repeat_words", "words.n_words"), 0.02, 0.1),
    Rule("duplicate_lines", _ratio("lines.n_dup_lines", "lines.n_lines"), 0.05, 0.3),
    Rule("open_lines", lambda: 1 - F.try_divide(F.col("quality.lines.n_ended"), F.col("quality.lines.n_lines")), 0.3, 0.8),
    Rule("doubled_words", _ratio("words.n_doubled", "words.n_words"), 0.05, 0.3),
    Rule("few_words", lambda: -F.try_divide(F.col("quality.words.n_distinct"), F.sqrt("quality.words.n_words")), -3.0, -1.5),
)


def fit_votes(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.8) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over the counts of vote patterns: the share of good documents, and for each rule the
    probabilities of each vote on good and on bad documents.

    Starts from rules that seldom call a good document bad, as each looks for one fault, of which a
    bad document has some; and counts BELIEF documents of either kind that vote so beside those there
    are, so that few documents don't merge or swap the two kinds. The result depends on the counts alone.
    """
    n_rules = len(counts[0][0]) if counts else 0
    rates = [dict(START) for _ in range(n_rules)]
    for _ in range(rounds):
        sums = [{v: [BELIEF * x for x in START[v]] for v in (1, -1, 0)} for _ in range(n_rules)]
        good = whole = 0.0
        for votes, n in counts:
            p = posterior(votes, prior, rates)
            good += n * p
            whole += n
            for tally, vote in zip(sums, votes, strict=True):
                tally[vote][0] += n * p
                tally[vote][1] += n * (1 - p)
        prior = min(max((good + 1) / (whole + 2), 0.01), 0.99)
        totals = [(sum(t[v][0] for v in t), sum(t[v][1] for v in t)) for t in sums]
        rates = [{v: (t[v][0] / g, t[v][1] / b) for v in t} for t, (g, b) in zip(sums, totals, strict=True)]
    return prior, rates


def posterior(votes: tuple[int, ...], prior: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    """The probability that a document with these votes is good, the rules being independent given that."""
    logit = math.log(prior / (1 - prior)) + sum(math.log(r[v][0] / r[v][1]) for r, v in zip(rates, votes, strict=True))
    return 1 / (1 + math.exp(-min(max(logit, -500.0), 500.0)))


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, text: str = "text", carry: tuple[str, ...] = ("*",)
) -> DataFrame:
    """All rows of ``docs``, the columns in ``carry`` as struct ``record``, with ``quality``,
    ``votes``, ``base_failed``, ``posterior`` and ``kept``.

    Counts and votes are written once and read both for the fit and for the verdicts.

    A document fails the base test with under 10 words or with over a fifth of its words in
    repeated windows; others are kept from ``threshold`` on. Null texts count as empty and fail.
    Equal texts get equal verdicts; an empty table gives no rows.
    """
    spark = docs.sparkSession
    words = F.col("quality.words")
    failed = (words["n_words"] < 10) | (100 * words["n_repeat_words"] > 20 * words["n_words"])
    featured = with_features(docs.select(F.struct(*carry).alias("record"), F.col(text).alias("quality_text")), "quality_text")
    votes = F.array(*[rule.vote() for rule in rules]).alias("votes")
    voted = written(featured.select("record", "quality", failed.alias("base_failed"), votes), new_folder(spark, "votes"), "voted")
    counted = voted.where("not base_failed").groupBy("votes").agg(F.count("*").alias("n"))
    # 3 ** rules rows at most, whatever the size of the corpus
    counts = sorted((tuple(row["votes"]), row["n"]) for row in counted.collect())
    prior, rates = fit_votes(counts)
    weights = F.lit(math.log(prior / (1 - prior)))
    for i, rate in enumerate(rates):
        for vote, (g, b) in rate.items():
            weights = weights + F.when(F.col("votes")[i] == vote, F.lit(math.log(g / b))).otherwise(F.lit(0.0))
    chance = 1 / (1 + F.exp(-weights))
    return voted.withColumn("posterior", chance).withColumn("kept", ~F.col("base_failed") & (chance >= threshold))


def judged_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op1_weak_supervision``: every document's counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = judge(docs, carry=("doc_id",))
    return judged.select(
        "record.doc_id",
        "quality.words.n_words",
        "quality.words.word_chars",
        "quality.n_symbols",
        "quality.lines.n_dup_lines",
        "quality.words.n_repeat_words",
        "base_failed",
        "kept",
        "votes",
        "posterior",
    )
