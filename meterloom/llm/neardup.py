"""Near duplicates by MinHash with tensored banding.

Two small collections of half keys, each a few minhashes, are computed for every set of shingles;
every pair of half keys, one of either collection, is the key of one table. So m + m half keys
serve m * m tables. Sets that share a key are candidates, and a link is confirmed on the full sets.

Within the sets of a key not all pairs are made. All compare with one pivot; linked sets are
contracted. What keys leave in several components compares with the set at the centre of what they
connect, and beyond that only sets that share a shingle in which both differ from that centre.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .shared import joined, new_folder, slices, small, written

BROADCAST_ROWS = 2_000_000
#: Bands of difference sizes in a factor of e.
BANDS = 8
#: A shingle's rows meet in cells of about so many by so many.
CELL = 1024
#: Bits of a set's parity sketch, in words of 64.
SKETCH_WORDS = 8
#: Pivots' sets of more bytes together are not broadcast.
BROADCAST_BYTES = 64 << 20
SKETCH = tuple(f"sketch{i}" for i in range(SKETCH_WORDS))


@dataclass(frozen=True)
class Banding:
    """``halves`` half keys of ``rows`` minhashes in either collection: 2 * halves * rows minhashes
    make halves ** 2 tables. A pair of similarity s is missed with probability under
    2 * (1 - s ** rows) ** halves; 0.8 gives 8e-5 as set here, 0.85 gives 6e-6, 0.9 gives 2e-7."""

    halves: int = 10
    rows: int = 2
    seed: int = 7


def _mix(x):
    """The finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, size: int = 5):
    """The sorted distinct 64-bit shingle hashes of each text of an Arrow array, as numpy arrays.

    A-Z are lower-cased, words stand between ASCII white space; a text of fewer words than ``size``
    is one shingle, and one without words or null has none.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = before[ends]
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(words) - size + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(size):
            rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _signer(banding: Banding, size: int):
    def sign(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        n_hashes = 2 * banding.halves * banding.rows
        rng = np.random.default_rng(banding.seed)
        a = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) | np.uint64(1)
        b = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch["text"], size)
                counts = np.array([len(x) for x in sets], np.int64)
                digests = [xxhash.xxh3_128(x.tobytes()).digest() for x in sets]
                kept = np.flatnonzero(counts)
                halves = np.zeros((len(sets), 2 * banding.halves), np.int64)
                sketch = np.zeros((len(sets), SKETCH_WORDS), np.int64)
                if len(kept):
                    flat = np.concatenate([sets[i] for i in kept])
                    starts = np.concatenate([[0], np.cumsum(counts[kept])[:-1]])
                    bits = 64 * SKETCH_WORDS
                    place = np.repeat(np.arange(len(kept)) * bits, counts[kept]) + (flat >> np.uint64(32)).astype(np.int64) % bits
                    odd = (np.bincount(place, minlength=len(kept) * bits) & 1).astype(np.uint8)
                    sketch[kept] = np.packbits(odd.reshape(len(kept), bits), axis=1).view(np.int64)
                    with np.errstate(over="ignore"):
                        for h in range(2 * banding.halves):
                            key = np.zeros(len(kept), np.uint64)
                            for r in range(h * banding.rows, (h + 1) * banding.rows):
                                hashed = flat * a[r] + b[r]
                                key = _mix(key * np.uint64(31) + np.minimum.reduceat(hashed ^ (hashed >> np.uint64(32)), starts))
                            halves[kept, h] = key.view(np.int64)
                flat_halves = pa.array(halves.reshape(-1))
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (2 * banding.halves))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        pa.array(counts),
                        pa.array([d if n else None for d, n in zip(digests, counts, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, flat_halves),
                        *map(pa.array, sketch.T.copy()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "halves", *SKETCH],
                )

    return sign


def _setter(size: int):
    def sets_of(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch["text"], size)
                ends, flat = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))],
                    names=["node", "shingles"],
                )

    return sets_of


def _verifier(percent: int):
    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            left, right = batch["left"], batch["right"]
            values = [(x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()) for x in (left, right)]
            linked = np.zeros(batch.num_rows, bool)
            (lv, lo), (rv, ro) = values
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return verify


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``percent`` hundredths of their union in common."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verifier(percent), "a long, b long")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) can reach.

    Alternates large and small stars: every node tells its larger, then its smaller neighbours of
    the smallest node it sees, until each edge leads to the smallest. Each round is written, so an
    executor that is lost costs one round; minima are combined before they are shuffled.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges-0")
    before, turn = None, 0
    while True:
        turn += 1
        ways = both(edges)
        # written, so that the rows of a hub are dealt to several tasks when they meet its minimum
        least = written(ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), folder, f"least-{turn}")
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # large: a > b now, in every row
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
        edges = written(small_star.distinct(), folder, f"edges-{turn}")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def possible(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible: see ``may_link``."""
    sketched = small(candidates.select("node", "n", *SKETCH), BROADCAST_ROWS // 4)
    side = lambda name: sketched.select(F.col("node").alias(name), F.struct("n", *SKETCH).alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(may_link(lambda c: F.col(f"of_a.{c}"), lambda c: F.col(f"of_b.{c}"), percent)).select("a", "b")


def may_link(x, y, percent: int):
    """Whether sets with the columns ``x(name)`` and ``y(name)`` may have ``percent`` hundredths of their union in common.

    That holds if they differ in (100 - percent) / (100 + percent) of the sum of their sizes at most.
    A bit of a sketch is the parity of the shingles hashed to it, so each bit in which two sketches
    differ stands for a shingle at least in which the sets do: nothing possible is left out.
    """
    differing = sum((F.bit_count(x(k).bitwiseXOR(y(k))) for k in SKETCH[1:]), F.bit_count(x(SKETCH[0]).bitwiseXOR(y(SKETCH[0]))))
    differing = F.greatest(differing.cast("long"), F.abs(x("n") - y("n")))
    return differing * (100 + percent) <= (100 - percent) * (x("n") + y("n"))


def pairs_by_difference(info: DataFrame, sets: DataFrame, percent: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(links, pairs) of (a, b): what is linked with its cluster's centre, and what else of different components may be linked.

    Sets are replaced by what each differs in from the set at the centre of its cluster, for x and y
    differ from each other in the same shingles as these differences do. So pages of one template
    keep little but their own words and the template's words that they lack. Two differences of s
    and t shingles that belong to linked sets have at least o = (s + t - d) / 2 in common, where d is
    the most that the sets may differ in; so they share one among the first s - o + 1 of the one and
    t - o + 1 of the other in the order of frequency, rarest first (prefix filter), and where o is
    not positive both are linked with the centre. Shingles of one difference alone come first and
    make no pair. No possible link is left out; every pair was found by a shared shingle.
    """
    top = F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")
    centres = info.groupBy("cluster").agg(top).select("cluster", (-F.col("top.minus")).alias("node"))
    centres = written(centres.join(sets, "node").select("cluster", F.col("node").alias("centre"), F.col("shingles").alias("core")), folder, "centres")
    n_bytes = centres.agg(F.sum(F.size("core").cast("long") * 8 + 64).alias("n")).first()["n"] or 0
    diff = F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles"))
    apart = (
        info.join(sets, "node")
        .join(F.broadcast(centres) if n_bytes <= BROADCAST_BYTES else centres, "cluster")
        .select("cluster", "node", "component", "n", *SKETCH, "centre", F.size("core").alias("core_n"), diff.alias("diff"))
        .withColumn("s", F.size("diff"))
    )
    near = F.col("s") * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("core_n"))
    apart = written(apart.withColumn("near", near), folder, "apart")
    links = apart.where("near and node != centre").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
    # what is linked with the centre needs no other link to it
    apart = apart.withColumn("component", F.when(F.col("near"), F.col("centre")).otherwise(F.col("component")))
    shingles = apart.select("cluster", "node", "s", "n", F.explode("diff").alias("shingle"))
    shared = shingles.groupBy("cluster", "shingle").agg(F.count("*").alias("df")).where("df > 1")
    most = F.expr(f"{100 - percent} * n div {percent}")  # over all sizes that n can link to
    ordered = (
        joined(shingles, written(shared, folder, "shared"), ["cluster", "shingle"], "df")
        .groupBy("node", "s", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))  # of one document
        .select("node", "own", (F.col("s") - F.size("own")).alias("alone"), most.alias("most"))
        .select("node", "alone", "most", F.posexplode("own").alias("at", "one"))
        .select("node", (F.col("alone") + F.col("at")).alias("at"), F.col("one.shingle").alias("shingle"), "most")
        .where("at <= most")
    )
    prefixes = written(ordered.join(apart.drop("diff", "centre", "core_n", "near"), "node"), folder, "prefixes")
    # A shingle's rows outside its largest component meet all its rows: those of one component seldom meet.
    by_part = prefixes.groupBy("cluster", "shingle", "component").agg(F.count("*").alias("k"))
    parted = by_part.groupBy("cluster", "shingle").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "component")).alias("top")).where("rows > top.k")
    parted = written(parted.select("cluster", "shingle", "rows", F.col("top.component").alias("largest")), folder, "parted")
    # the sizes of the other difference for which the shingle lies in the prefix
    band = lambda s: F.floor(BANDS * F.log(s))
    low, high = F.greatest(F.col("s") - F.col("most"), F.lit(1)), F.col("s") + F.col("most") - 2 * F.col("at")
    banded = (
        joined(prefixes, parted, ["cluster", "shingle"], "rows")
        .where(high >= low)
        .withColumn("band", band(F.col("s")))
        .withColumn("to", F.explode(F.sequence(band(low), band(high))))
        .withColumn("minor", F.col("component") != F.col("largest"))
        .drop("largest")
    )
    x, y = in_cells(written(banded, folder, "banded"), folder)
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("cluster", "shingle", "row", "column")]
    on += [F.col("x.band") == F.col("y.to"), F.col("x.to") == F.col("y.band")]
    differ = (F.col("x.component") != F.col("y.component")) & (~F.col("y.minor") | (F.col("x.node") > F.col("y.node")))
    both_at = F.least(F.col("x.s") - F.col("x.at"), F.col("y.s") - F.col("y.at"))
    sizes = F.col("x.n") + F.col("y.n")
    enough = (2 * both_at - F.col("x.s") - F.col("y.s")) * (100 + percent) >= -(100 - percent) * sizes
    likely = may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent)
    condition = differ & enough & likely
    for equal in on:
        condition = equal & condition
    found = x.join(y, condition).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    return links, found


def in_cells(banded: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows ``x`` that are to meet others and all rows ``y``, with the ``row`` and ``column`` of the cell where they meet.

    What shares a key (cluster, shingle, band, to) is dealt to a grid of cells by hashes of the nodes, so
    that a key of any number of rows makes cells of about CELL by CELL pairs for as many tasks.
    """
    keys = ["cluster", "shingle", "band", "to"]
    sizes = banded.where(F.col("rows") > CELL).groupBy(*keys).agg(F.count("*").alias("n_y"), F.count_if("minor").alias("n_x"))
    sizes = written(sizes, folder, "key-sizes")
    met = sizes.select("cluster", "shingle", F.col("to").alias("band"), F.col("band").alias("to"), F.col("n_y").alias("met"))
    parts = lambda n: F.ceil(F.col(n) / CELL)
    large = sizes.join(met, keys).where("n_x > 0").where(F.greatest("n_x", "met") > CELL)
    large = written(large.select(*keys, "n_x", parts("n_x").alias("down"), parts("met").alias("across")), folder, "large-keys")
    banded = banded.drop("rows")
    own = F.xxhash64("node")
    if large.isEmpty():
        whole = banded.withColumns({"row": F.lit(0), "column": F.lit(0)})
        return whole.where("minor").alias("x"), whole.alias("y")
    size = lambda n: F.coalesce(F.col(n), F.lit(1))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (size(n) - 1).cast("int")))
    one_of = lambda n: F.pmod(own, size(n)).cast("int")
    x = joined(banded.where("minor"), large.select(*keys, "n_x", "down", "across"), keys, "n_x", "left")
    x = x.withColumn("row", one_of("down")).withColumn("column", all_of("across"))
    # seen from y, the key of x is the one with its bands exchanged
    facing = sizes.select(*keys, F.col("n_y").alias("own_y")).join(
        large.select("cluster", "shingle", F.col("to").alias("band"), F.col("band").alias("to"), "down", "across"), keys
    )
    y = joined(banded, written(facing, folder, "facing-keys"), keys, "own_y", "left")
    y = y.withColumn("column", one_of("across")).withColumn("row", all_of("down"))
    return x.alias("x"), y.alias("y")


def near_duplicates(docs: DataFrame, banding: Banding = Banding(), size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when their shingle sets have ``percent`` hundredths of their union in
    common; ``component_id`` is the smallest id reachable over links, and ``kept`` says that it is
    the row's own. Null and empty texts have no shingles and no links. Equal sets are compared once,
    however many rows share them. Rows that share an id count as one document: they get one
    component and are kept or dropped together. A null id joins no component, though its row does
    count as a copy: it gets the component of its set, and is kept if there is none.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "neardup")
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, halves array<long>, " + ", ".join(f"{k} long" for k in SKETCH)
    signed = written(slim.mapInArrow(_signer(banding, size), schema), folder, "signed")
    # One node for each distinct set: its smallest id.
    copies = written(
        signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows")).where("n_rows > 1 and node is not null"),
        folder,
        "copies",
    )
    node = F.when(F.col("n_shingles") > 0, F.coalesce("node", "doc_id"))
    placed = written(joined(signed, copies, ["digest"], "n_rows", "left").withColumn("node", node), folder, "placed")
    nodes = placed.where("node = doc_id").dropDuplicates(["node", "digest"])
    # All tables' keys; those of a single set lead to no candidate.
    m = banding.halves
    tables = F.flatten(
        F.transform(
            F.slice("halves", 1, m),
            lambda x, i: F.transform(F.slice("halves", m + 1, m), lambda y, j: F.xxhash64(x, y, i, j)),
        )
    )
    keyed = nodes.select("node", F.explode(tables).alias("key"))
    keys = written(keyed.groupBy("key").agg(F.count("*").alias("n_nodes"), F.min("node").alias("pivot")).where("n_nodes > 1"), folder, "keys")
    members = written(joined(keyed, keys, ["key"], "n_nodes"), folder, "members")
    candidates = written(
        members.groupBy("node").agg(F.sum("n_nodes").alias("weight")).join(nodes.select("node", F.col("n_shingles").alias("n"), *SKETCH), "node"), folder, "candidates"
    )
    ids = small(candidates.select(F.col("node").alias("doc_id")), BROADCAST_ROWS)
    sets = written(
        slim.join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "node").mapInArrow(_setter(size), "node long, shingles array<long>").dropDuplicates(),
        folder,
        "sets",
    )
    # Every member of a key against the key's pivot.
    first = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = written(possible(first, candidates, percent), folder, "pairs-1")
    links = written(confirmed(first, sets, percent), folder, "links-1")
    parts = components(links, new_folder(spark, "neardup-parts"))
    # Keys whose sets are still in several components, and what such keys connect.
    labelled = written(
        members.join(small(parts, BROADCAST_ROWS), "node", "left").select("key", "n_nodes", "node", F.coalesce("component", "node").alias("component")), folder, "labelled"
    )
    open_keys = written(
        labelled.groupBy("key", "n_nodes").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("hub")).where("lo != hi and n_nodes > 2"),
        folder,
        "open",
    ).drop("lo", "hi")
    open_rows = joined(labelled.drop("n_nodes"), open_keys, ["key"], "n_nodes")
    clusters = components(open_rows.select(F.col("node").alias("a"), F.col("hub").alias("b")), new_folder(spark, "neardup-clusters"))
    info = clusters.withColumnRenamed("component", "cluster").join(candidates, "node").join(parts, "node", "left")
    info = written(info.withColumn("component", F.coalesce("component", "node")), folder, "info")
    central, second = pairs_by_difference(info, sets, percent, folder)
    second = written(second.join(first, ["a", "b"], "left_anti"), folder, "pairs-2")
    more = written(confirmed(second, sets, percent).unionByName(central), folder, "links-2")
    found = components(links.unionByName(more), new_folder(spark, "neardup-components"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    return (
        placed.join(small(found, BROADCAST_ROWS // 2), "node", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )


def with_own_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(record, own) for each row, ``record`` being a struct of all columns, and the ``own`` keys of several rows.

    ``own`` is the row's id where that is of this row alone. Null ids, and ids of several rows, get a
    hash of id and text above 2 ** 62 instead, so only rows that are equal in both share a key.
    """
    folder = new_folder(docs.sparkSession, "neardup-own")
    number = F.col(key).cast("long")
    hashed = F.xxhash64(number, F.col(text)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = written(docs.select(number.alias("id"), hashed.alias("own")).groupBy("id", "own").agg(F.count("*").alias("n")), folder, "rows")
    repeated = written(rows.where("n > 1").select("own").distinct(), folder, "repeated")
    shared = written(
        rows.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("id").alias("shared_id")), folder, "shared"
    )
    keyed = docs.select(F.struct("*").alias("record"), number.alias("id"), hashed.alias("hashed")).join(
        small(shared, BROADCAST_ROWS), F.col("id") == F.col("shared_id"), "left"
    )
    return keyed.select("record", F.when(F.col("id").isNull() | F.col("shared_id").isNotNull(), F.col("hashed")).otherwise(F.col("id")).alias("own")), repeated


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id.

    Every row is judged by its own text. Rows with a null id, and rows whose id another row has too,
    are members of groups like others and come after all other ids; of rows that are equal in id and
    text one stays, texts without words included.
    """
    keyed, repeated = with_own_keys(docs)
    verdicts = near_duplicates(keyed, key="own", text="record.text")
    gone = written(verdicts.where("not kept").select(F.col("doc_id").alias("own")).distinct(), new_folder(docs.sparkSession, "neardup-gone"), "gone")
    left = keyed.join(small(gone, BROADCAST_ROWS), "own", "left_anti")
    if repeated.isEmpty():
        return left.select("record.*")
    repeated = small(repeated, BROADCAST_ROWS)
    # compared in full, as a hash may collide
    one_each = left.join(repeated, "own", "left_semi").groupBy("own", "record.doc_id", "record.text").agg(F.first("record").alias("record"))
    return left.join(repeated, "own", "left_anti").select("record.*").unionByName(one_each.select("record.*"))


def grouped_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op2_tensored_minhash``: every document's group of near copies."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)


GROUPED_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, w.b FROM reached r JOIN ways w ON r.other = w.a
), least_ids AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ids USING (doc_id)
"""
