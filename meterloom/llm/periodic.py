"""Periodic runs of words by block convolution.

A text's words are numbered by value. At each dyadic scale B the words are cut into blocks of B, and
the sums of squared differences between a block and all places of the window behind it come out of
one exact integer number-theoretic transform; a sum of zero means that the block occurs there, at a
distance from B to 2B (at the first scale, from 1). A run of period q in that span with at least
max(24, 3q) words holds a whole block whose next occurrence is q words on, so each run is seeded by
some distance; seeds are extended to both sides as far as the period holds. All work is a map over
texts: nothing is shuffled, and a batch of short texts is worked on as one long sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import slices

#: The modulus of the transform, 15 * 2 ** 27 + 1, and a generator of its multiplicative group.
MODULUS, GENERATOR = 2013265921, 31
FIRST_SCALE = 8
#: Values of a transform's batch, which bounds its memory.
BATCH = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def _mod(x):
    """x modulo MODULUS; division by a scalar is vectorised in numpy, the remainder is not."""
    return x - (x // MODULUS) * MODULUS


def _powers(base: int, n: int):
    """base ** 0 .. base ** (n - 1) modulo MODULUS."""
    import numpy as np

    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _mod(out[:more] * pow(base, have, MODULUS))
        have += more
    return out


def transform(columns):
    """The number-theoretic transform of each column, in bit-reversed order; the rows are a power of two."""
    x = columns.copy()
    n, width = x.shape
    half = n // 2
    while half:
        twiddles = _powers(pow(GENERATOR, (MODULUS - 1) // (2 * half), MODULUS), half)[None, :, None]
        v = x.reshape(-1, 2, half, width)
        total = _mod(v[:, 0] + v[:, 1])
        v[:, 1] = _mod((v[:, 0] - v[:, 1] + MODULUS) * twiddles)
        v[:, 0] = total
        half //= 2
    return x


def inverse(columns):
    """The columns of which these are the transforms."""
    x = columns.copy()
    n, width = x.shape
    half = 1
    while half < n:
        root = pow(GENERATOR, (MODULUS - 1) // (2 * half), MODULUS)
        twiddles = _powers(pow(root, MODULUS - 2, MODULUS), half)[None, :, None]
        v = x.reshape(-1, 2, half, width)
        odd = _mod(v[:, 1] * twiddles)
        v[:, 1] = _mod(v[:, 0] - odd + MODULUS)
        v[:, 0] = _mod(v[:, 0] + odd)
        half *= 2
    return _mod(x * pow(n, MODULUS - 2, MODULUS))


def squared_differences(blocks, windows):
    """Sums of squared differences of each block (a column of B values) at the offsets 0 to B of its window (2B values).

    Exact as long as B times the largest squared value is below MODULUS.
    """
    import numpy as np

    size, width = blocks.shape
    turned = np.zeros((2 * size, width), np.int64)
    turned[0], turned[-1 : -size : -1] = blocks[0], blocks[1:]
    products = inverse(_mod(transform(turned) * transform(windows)))[: size + 1]
    sums = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(windows * windows, axis=0)])
    return (blocks * blocks).sum(axis=0) + sums[size : 2 * size + 1] - sums[: size + 1] - 2 * products


def _value_bits(size: int) -> int:
    """The widest values for which a sum over ``size`` squared differences stays below the modulus."""
    return max(1, (MODULUS.bit_length() - 2 - (size.bit_length() - 1)) // 2)


class _Extents:
    """How far words agree with those ``d`` further on, by binary search over hashes of prefixes.

    Hashes never call equal words unequal, so an extent is never too short; ``exactly`` mends those
    that are too long, and seeds whose words are unequal with equal values.
    """

    def __init__(self, ids) -> None:
        import numpy as np

        self.ids = ids
        self.powers = _powers(GENERATOR**5, len(ids) + 1)
        mixed = _mod((ids.astype(np.int64) + 1) * 1_000_003 + 12_345)
        self.sums = np.concatenate([[0], _mod(np.cumsum(_mod(mixed * self.powers[:-1])))])

    def _agree(self, start, size, d):
        """Whether words [start, start + size) equal those d further on, by their hashes."""
        near = _mod(self.sums[start + size] - self.sums[start] + MODULUS)
        far = _mod(self.sums[start + d + size] - self.sums[start + d] + MODULUS)
        return _mod(near * self.powers[d]) == far

    def stretches(self, start, stop, d):
        """The widest [start, stop) around those given in which each word equals the one d further on."""
        import numpy as np

        n = len(self.ids)
        low, high = stop, n - d  # stop lies in [low, high]
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self._agree(stop, middle - stop, d)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        left, right = np.zeros_like(start), start
        while (left < right).any():
            middle = (left + right) // 2
            good = self._agree(middle, start - middle, d)
            left, right = np.where(good, left, middle + 1), np.where(good, middle, right)
        return left, low

    def exactly(self, start: int, stop: int, d: int) -> list[tuple[int, int]]:
        """The widest stretches of words that really equal those d further on, among them all within [start, stop)."""
        import numpy as np

        if np.array_equal(self.ids[start:stop], self.ids[start + d : stop + d]):
            return [(start, stop)]
        edges = np.diff(np.concatenate([[0], self.ids[:-d] == self.ids[d:], [0]]).astype(np.int8))
        return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def _seeds(ids, size: int, starts):
    """(block start, distance) of the blocks' occurrences at distances of ``size`` up to twice that (first scale: from 1)."""
    import numpy as np

    # Equal words have equal values; unequal ones may too, which extension finds out.
    values = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _value_bits(size))).astype(np.int64)
    padded = np.concatenate([values, np.zeros(3 * size, np.int64)])
    found_at, found_d = [], []
    for i in range(0, len(starts), max(1, BATCH // (2 * size))):
        own = starts[i : i + max(1, BATCH // (2 * size))]
        blocks = padded[own + np.arange(size)[:, None]]
        for base in (0, size) if size == FIRST_SCALE else (size,):
            windows = padded[own + base + np.arange(2 * size)[:, None]]
            offset, block = np.nonzero(squared_differences(blocks, windows)[:size] == 0)
            d = offset + base
            inside = (d > 0) & (own[block] + d + size <= len(ids))
            found_at.append(own[block][inside])
            found_d.append(d[inside])
    return np.concatenate(found_at or [np.empty(0, np.int64)]), np.concatenate(found_d or [np.empty(0, np.int64)])


def _smallest_period(ids, start: int, d: int) -> bool:
    """Whether d words from ``start`` on, of a stretch of period d, have no smaller period that divides d."""
    import numpy as np

    once, rest, divisor = ids[start : start + d], d, 2
    while rest > 1:
        if divisor * divisor > rest:
            divisor = rest
        if rest % divisor == 0:
            step = d // divisor
            if np.array_equal(once[step:], once[:-step]):  # step divides d, so one round of d tells
                return False
            while rest % divisor == 0:
                rest //= divisor
        divisor += 1
    return True


def find_runs(ids, least: int = 24, times: int = 3, texts=None):
    """(start, length, period) of all runs in a sequence of word numbers, ordered by start and period.

    Where several texts stand in the sequence, with words of no other place between them, ``texts`` has
    the text of each word: what recurs in another text alone is then not looked at.

    A run has a smallest period q, max(``least``, ``times`` * q) words at least, and no neighbour that
    keeps the period. ``least`` is 24 or more and ``times`` 3 or more: the blocks' sizes rest on that.
    """
    import numpy as np

    if least < 3 * FIRST_SCALE or times < 3:
        raise ValueError("least must be 24 or more, times 3 or more")
    n = len(ids)
    runs: dict[tuple[int, int], int] = {}
    if n < least:
        return np.empty((0, 3), np.int64)
    order = np.argsort(ids, kind="stable")
    gaps = np.full(n, n, np.int64)  # to the word's next occurrence
    same = ids[order[:-1]] == ids[order[1:]]
    if texts is not None:
        same &= texts[order[:-1]] == texts[order[1:]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    size, extents = FIRST_SCALE, None
    widest = gaps[: n // size * size].reshape(-1, size).max(axis=1)
    covered = np.empty((0, 2), np.int64)
    while times * size <= n or size == FIRST_SCALE:
        # A block can occur again within two of its sizes only if each of its words does.
        starts = np.flatnonzero(widest < 2 * size) * size
        if len(covered) and len(starts):
            # All occurrences of a block in a run of a period up to its size are the run's own, as far as the run goes.
            at = np.searchsorted(covered[:, 0], starts, "right") - 1
            ends = np.maximum.accumulate(covered[:, 1])
            starts = starts[~((at >= 0) & (ends[at] >= starts + 3 * size))]
        at, d = _seeds(ids, size, starts)
        if len(at):
            if len(covered):
                own = np.searchsorted(covered[:, 0], at, "right") - 1
                outside = ~((own >= 0) & (np.maximum.accumulate(covered[:, 1])[own] >= at + d + size))
                at, d = at[outside], d[outside]
            by = np.lexsort((at, d))
            at, d = at[by], d[by]
            first = np.ones(len(at), bool)
            first[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1] + size)
            start, d = at[first], d[first]
            stop = np.append(at[np.flatnonzero(first)[1:] - 1], at[-1:]) + size
            if len(start):
                extents = extents or _Extents(ids)
                left, right = extents.stretches(start, stop, d)
                enough = right - left + d >= np.maximum(least, times * d)
                for begin, end, k in zip(left[enough].tolist(), right[enough].tolist(), d[enough].tolist(), strict=True):
                    if runs.get((begin, k)) != end + k - begin:
                        for first_word, last_word in extents.exactly(begin, end, k):
                            length = last_word + k - first_word
                            if length >= max(least, times * k) and _smallest_period(ids, first_word, k):
                                runs[first_word, k] = length
        if runs:
            covered = np.array(sorted((s, s + length) for (s, q), length in runs.items() if q <= 2 * size), np.int64).reshape(-1, 2)
        size *= 2
        if len(widest) % 2:
            widest = np.append(widest, n)
        widest = widest.reshape(-1, 2).max(axis=1)[: n // size]
        if not len(widest):
            break
    found = np.array([(s, length, q) for (s, q), length in runs.items()], np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _words(texts):
    """All words of the texts, and where each text's words start; a null text has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.searchsorted(row[real], np.arange(len(texts) + 1))


def _finder(least: int, times: int):
    def find(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (part for whole in batches for part in slices(whole, "text")):
            words, starts = _words(batch["text"])
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # A number of its own stands behind each text, so that no run crosses over.
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            joined = np.full(len(ids) + batch.num_rows, -1, np.int64)
            joined[np.arange(len(ids)) + row] = ids
            joined[starts[1:] + np.arange(batch.num_rows)] = len(coded.dictionary) + np.arange(batch.num_rows)
            runs = find_runs(joined, least, times, np.repeat(np.arange(batch.num_rows), np.diff(starts) + 1))
            of = np.searchsorted(starts[1:] + np.arange(batch.num_rows), runs[:, 0], "left")
            begin = runs[:, 0] - of  # among the words of the batch
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, begin + runs[:, 2], 1)
            np.add.at(drop, begin + runs[:, 1], -1)
            kept = np.cumsum(drop[:-1]) == 0
            bounds = np.searchsorted(row[kept], np.arange(batch.num_rows + 1))
            kept_words = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), words.filter(pa.array(kept)))
            items = pa.StructArray.from_arrays([pa.array(begin - starts[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()), items)
            collapsed = pc.cast(pc.binary_join(kept_words, pa.scalar(" ", pa.large_string())), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(np.diff(starts)), lists, collapsed],
                names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
            )

    return find


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``.

    ``runs`` (start, length, period), by start and period, are the stretches of words (between ASCII
    white space) with smallest period q and max(``least``, ``times`` * q) words that no neighbour extends;
    ``collapsed`` is the text's words, without those that a run holds beyond its first q, joined by a space.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows are judged each by its
    own text: null ids and repeated rows come out as often as they go in. Long texts are searched whole.
    An empty table gives no rows.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_finder(least, times), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a tail made periodic in a tenth of the texts, chosen by a hash of the id.

    With h the id's crc32 and g its tenth: where h ends in 0, each word from a = g mod n on becomes
    word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts, and those with a null id, stay.
    """
    hashed = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(hashed / 10)
    planted = lambda w: _let(F.struct(w.alias("w"), F.pmod(g, F.size(w)).cast("int").alias("a")), lambda x: _tail(x["w"], x["a"], g))
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    return docs.withColumn(text, F.when(hashed % 10 == 0, _let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))).otherwise(F.col(text)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _tail(words: Column, a: Column, g: Column) -> Column:
    period = (1 + F.floor((F.size(words) - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    return _let(period, lambda p: F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p)))), " "))


def collapsed_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op13_block_convolution``: the runs of every document, of which a tenth have a planted one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs))
    # The greatest exact length / period: cross products, as quotients may round alike.
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "runs", best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
