"""Token ids in files of patched frame-of-reference blocks.

A block holds 128 ids. It stores its smallest id, and for each id what exceeds that, packed at the
width that suffices for nine ids in ten; the high bits of the others are patched in from a list of
exceptions. An index of block starts and a table of documents stand at the file's end, so a reader
can seek to any document.

File: 8 bytes of magic, the blocks, the blocks' offsets (u64 each), the documents (id i64, 1 if the
id is not null u64, number of ids u64), then numbers of blocks, ids and documents (u64) and magic.
Block: smallest id u32, width u8, number of exceptions u8, number of ids u16; ``width`` rows of four
32-bit words; the exceptions' places u8 and their high bits u32. All little-endian.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window, functions as F

from .shared import new_folder, open_file, put_file, worker_state, written

MAGIC = b"PFORIDS1"
BLOCK, LANES, HEAD = 128, 4, 8
#: The place of the width among a block's sorted bit lengths: nine in ten fit.
PERCENTILE = 115


def _packed(low, width):
    """(blocks, 128) numbers under 2 ** width as (blocks, 4 * width) 32-bit words, four lanes side by side."""
    import numpy as np

    rows = low.reshape(len(low), BLOCK // LANES, LANES).astype(np.uint32)
    words = np.zeros((len(low), width, LANES), np.uint32)
    for r in range(BLOCK // LANES):
        word, shift = divmod(r * width, 32)
        words[:, word] |= rows[:, r] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= rows[:, r] >> np.uint32(32 - shift)
    return words.reshape(len(low), width * LANES)


def _unpacked(words, width):
    import numpy as np

    words = words.reshape(len(words), width, LANES)
    rows = np.zeros((len(words), BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for r in range(BLOCK // LANES if width else 0):
        word, shift = divmod(r * width, 32)
        rows[:, r] = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            rows[:, r] |= words[:, word + 1] << np.uint32(32 - shift)
        rows[:, r] &= mask
    return rows.reshape(len(words), BLOCK)


def encode_blocks(ids):
    """The blocks of an array of ids, and their sizes in bytes."""
    import numpy as np

    n = -(-len(ids) // BLOCK)
    values = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(n, BLOCK)
    least = values.min(axis=1)
    over = values - least[:, None]
    bits = np.frexp(over.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(bits, PERCENTILE, axis=1)[:, PERCENTILE].astype(np.int64)
    patched = bits > width[:, None]
    n_patched = patched.sum(axis=1)
    sizes = HEAD + 4 * LANES * width + 5 * n_patched
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    head = np.zeros(n, np.dtype([("least", "<u4"), ("width", "u1"), ("patched", "u1"), ("count", "<u2")]))
    head["least"], head["width"], head["patched"], head["count"] = least, width, n_patched, BLOCK
    if n:
        head["count"][-1] = len(ids) - BLOCK * (n - 1)
        out[at[:-1, None] + np.arange(HEAD)] = head.view(np.uint8).reshape(n, HEAD)
    for w in np.unique(width[width > 0]).tolist():
        blocks = np.flatnonzero(width == w)
        words = _packed(over[blocks] & np.uint32((1 << w) - 1), w).astype("<u4").view(np.uint8)
        out[at[blocks][:, None] + HEAD + np.arange(4 * LANES * w)] = words
    block, place = np.nonzero(patched)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(n_patched) - n_patched, n_patched)
    lists = at[block] + HEAD + 4 * LANES * width[block]
    out[lists + rank] = place
    high = (over[block, place].astype(np.uint64) >> width[block].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(lists + n_patched[block] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), sizes


def decode_blocks(data: bytes, at):
    """The ids of the blocks that start at the offsets ``at`` of ``data``."""
    import numpy as np

    raw, at = np.frombuffer(data, np.uint8), np.asarray(at, np.int64)
    head = raw[at[:, None] + np.arange(HEAD)].reshape(-1).view(np.dtype([("least", "<u4"), ("width", "u1"), ("patched", "u1"), ("count", "<u2")]))
    width, n_patched = head["width"].astype(np.int64), head["patched"].astype(np.int64)
    over = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        blocks = np.flatnonzero(width == w)
        words = raw[at[blocks][:, None] + HEAD + np.arange(4 * LANES * w)].reshape(-1).view("<u4")
        over[blocks] = _unpacked(words.reshape(len(blocks), w * LANES), w)
    block = np.repeat(np.arange(len(at)), n_patched)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(n_patched) - n_patched, n_patched)
    lists = at[block] + HEAD + 4 * LANES * width[block]
    high = raw[(lists + n_patched[block] + 4 * rank)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    over[block, raw[lists + rank]] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    values = over + head["least"][:, None]
    return values[np.arange(BLOCK) < head["count"][:, None]]


class WordEncoder:
    """Encodes whole texts word by word, each distinct word of a slice once, where the tokenizer is of the known kind.

    Such a tokenizer drops white space, splits at it and encodes what lies between on its own, and it
    parts a letter from a sign other than an apostrophe after it; so the ids of a text are those of
    its words in turn, and frequent words come from a cache of a fixed number of entries. Texts with
    the start of a special token are encoded as they are, and so are all texts by any other tokenizer.
    """

    #: The normaliser and the splitting of the known kind, and what ends its words.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
    END = "</w>"

    #: A letter and an ASCII sign after it, which the tokenizer parts.
    SEAM = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"

    def __init__(self, path: str, most: int = 400_000) -> None:
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(self.END)]] = True
        kind = json.loads(self.tokenizer.to_str())
        added = [x["content"] for x in kind["added_tokens"]]
        self.by_words = (
            (kind["normalizer"], kind["pre_tokenizer"], kind["model"].get("end_of_word_suffix")) == (self.NORMALIZER, self.SPLIT, self.END)
            and kind["post_processor"] is None
            and all(x.startswith("<|") for x in added)
        )

    def _encode_words(self, words: list[str]) -> list[bytes]:
        import numpy as np

        found: list[bytes | None] = [None] * len(words)
        # Letters alone make one piece, whose last id ends a word: as every word has such an id at
        # least, as many of them as words say that each has one.
        simple = [i for i, w in enumerate(words) if w.isalpha()]
        for k in range(0, len(simple), 1000):
            part = simple[k : k + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(words[i] for i in part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                for i, a, b in zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    found[i] = ids[a:b].tobytes()
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, "<u4").tobytes()
        return found

    def __call__(self, texts, end_id: int):
        """The ids of all texts one after another, with the end id after each, and the numbers of ids."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|" if self.by_words else "")
        odd = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        spaced = pc.replace_substring_regex(pc.ascii_lower(pc.if_else(special, "", texts)), self.SEAM, "\\1 \\2")
        lists = pc.ascii_split_whitespace(spaced)
        flat = lists.flatten()
        coded = pc.dictionary_encode(flat)
        words = coded.dictionary.to_pylist()
        ids = [self.known.get(w) for w in words]
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._encode_words([words[i] for i in new]), strict=True):
            ids[i] = x
            if len(self.known) < self.most:
                self.known[words[i]] = x
        lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(lengths)])[:-1]
        codes = coded.indices.to_numpy() if len(flat) else np.empty(0, np.int64)
        each = lengths[codes] if len(codes) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        stream = pool[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])] if len(codes) else pool
        stops = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        counts = np.diff(stops)
        if len(odd):
            parts = [stream[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
            whole = pa.Array.from_pandas(texts.take(pa.array(odd))).to_pylist()
            for i, e in zip(odd.tolist(), self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, "<u4")
            counts = np.array([len(x) for x in parts], np.int64)
            stream = np.concatenate(parts)
        return np.insert(stream, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def _writer(folder: str, tokenizer: str, end_id: int, slice_bytes: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoders = worker_state().__dict__.setdefault("encoders", {})
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.pfor"
        docs, sizes, n_ids = [], [], 0

        def chunks():
            nonlocal n_ids
            yield MAGIC
            rest = np.empty(0, np.uint32)
            for whole in batches:
                cuts = np.cumsum(pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy(zero_copy_only=False)) // slice_bytes
                edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), whole.num_rows]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if tokenizer not in encoders:
                        encoders[tokenizer] = WordEncoder(tokenizer)
                    batch = whole.slice(a, b - a)
                    ids, counts = encoders[tokenizer](batch["text"], end_id)
                    n_ids += len(ids)
                    rows = np.zeros((len(counts), 3), "<i8")
                    rows[:, 0] = pc.fill_null(batch["doc_id"], 0).to_numpy(zero_copy_only=False)
                    rows[:, 1] = pc.is_valid(batch["doc_id"]).to_numpy(zero_copy_only=False)
                    rows[:, 2] = counts
                    docs.append(rows)
                    ids = np.concatenate([rest, ids])
                    full = len(ids) - len(ids) % BLOCK
                    rest = ids[full:]
                    data, each = encode_blocks(ids[:full])
                    sizes.append(each)
                    yield data
            data, each = encode_blocks(rest)
            sizes.append(each)
            yield data
            starts = len(MAGIC) + np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[:-1]
            yield starts.astype("<u8").tobytes()
            yield b"".join(x.tobytes() for x in docs)
            yield np.array([len(starts), n_ids, sum(map(len, docs))], "<u8").tobytes()
            yield MAGIC

        size = put_file(path, chunks())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "path": path, "bytes": size, "n_docs": sum(map(len, docs)), "n_ids": n_ids}],
            schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", slice_bytes: int = 8 << 20, in_order: bool = True
) -> DataFrame:
    """Write the ids of all texts below ``folder``, in ascending order of ``key``; returns the files.

    With ``in_order`` false, rows are written as they stand in ``docs``, a file for each partition, and
    nothing is shuffled: for tables that were shuffled and stored before, whose order this keeps.

    Columns: part, path, bytes, n_docs, n_ids, start (ids in the files before). A file per range of
    keys appears under its name when whole, and a task that runs again writes the same file. A null
    text has the end id alone; null keys come first; rows that share a key stand in the order of a hash of the text;
    an empty table gives files without documents, or none. Long texts are encoded whole.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if in_order:
        # Rows of one id are told apart by their texts, and equal rows by their places, or one file would hold them all.
        slim = slim.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
        slim = slim.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place").drop("hash", "place")
    files = written(
        slim.mapInArrow(_writer(folder, tokenizer, end_id, slice_bytes), "part int, path string, bytes long, n_docs long, n_ids long"), folder, "files"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read_documents(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    blocks_at_once = 8192
    for batch in batches:
        for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
            with open_file(path) as f:
                size = f.size()
                f.seek(size - len(MAGIC) - 24)
                n_blocks, n_ids, n_docs = np.frombuffer(f.read(24), "<u8").tolist()
                if f.read(len(MAGIC)) != MAGIC:
                    raise ValueError(f"{path} is not a token file, or not whole")
                docs_at = size - len(MAGIC) - 24 - 24 * n_docs
                f.seek(docs_at - 8 * n_blocks)
                starts = np.frombuffer(f.read(8 * n_blocks), "<u8").astype(np.int64)
                docs = np.frombuffer(f.read(24 * n_docs), "<i8").reshape(-1, 3)
                stops = np.append(starts[1:], docs_at - 8 * n_blocks)
                crcs = np.zeros(n_docs, np.int64)
                doc, crc, left = 0, 0, int(docs[0, 2]) if n_docs else 0
                for k in range(0, n_blocks, blocks_at_once):
                    span = starts[k : k + blocks_at_once]
                    f.seek(int(span[0]))
                    data = f.read(int(stops[min(k + blocks_at_once, n_blocks) - 1] - span[0]))
                    ids = memoryview(decode_blocks(data, span - span[0]).astype("<u4").tobytes())
                    at = 0
                    while at < len(ids):
                        take = min(4 * left, len(ids) - at)
                        crc = zlib.crc32(ids[at : at + take], crc)
                        at, left = at + take, left - take // 4
                        if not left:
                            crcs[doc] = crc
                            doc, crc = doc + 1, 0
                            left = int(docs[doc, 2]) if doc < n_docs else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[:, 0], mask=docs[:, 1] == 0),
                        pa.array(start + np.cumsum(docs[:, 2]) - docs[:, 2]),
                        pa.array(docs[:, 2]),
                        pa.array(crcs),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, all ids decoded."""
    tasks = 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("path", "start").repartition(max(1, min(files.count(), tasks)))
    return spread.mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, in_order: bool = True) -> DataFrame:
    """Write ``docs`` as token files with the public word vocabulary and read them back.

    (doc_id, start, n_tokens, ids_crc32) for each row, repeated ones included; a null or empty text
    has the end id alone, a null id stays null, other columns are left out, an empty table gives no rows.
    """
    import public_tokenizers

    folder = new_folder(docs.sparkSession, "tokens")
    return read_documents(write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), in_order=in_order))


def encoded_documents(spark, sf_dir: str) -> DataFrame:
    """Query ``op3_patched_frames``: every document's place and digest, from the files."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
