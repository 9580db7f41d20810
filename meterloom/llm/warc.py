"""WARC records in seekable Zstandard bundles.

A bundle's records are grouped into frames that decompress on their own. A skippable frame at the
end holds the seek table (the public seekable format: compressed and decompressed size of each
frame), and an index maps each record to its frame and its offset within the decompressed frame.
The block of a response is an HTTP response with the page's html as its body, the payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .shared import joined, new_folder, open_file, put_file, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2026-01-01T00:00:00Z"


def record_id(name: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


def holder_name(page_id, digest: str) -> str:
    """The name that gives a record its id which others refer to: one row alone has this page id and payload."""
    return f"page:{page_id}:{digest}"


def warc_record(page_id, url, kind: str, payload: bytes, n_bytes: int, digest: str, refers_to, name: str | None = None, sole: bool = True) -> bytes:
    """One record, whose id comes from ``name`` (``holder_name`` if not given); a revisit has no block, and names the payload's digest and the record that has it.

    Where the page that a revisit refers to has that payload in several rows (not ``sole``), only the page is named.
    Of a URL only what may not stand in a header is percent-encoded: white space, controls, and what is beyond ASCII.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(name or holder_name(page_id, digest))}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if sole:
            head.append(f"WARC-Refers-To: <{record_id(holder_name(refers_to, digest))}>")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    block = b""
    if kind != "revisit":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data, at: int = 0):
    """(headers, payload, end) of the record at an offset; a revisit's payload is empty."""
    stop = data.index(b"\r\n\r\n", at)
    lines = bytes(data[at:stop]).decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    block = data[start:end]
    return headers, block[block.index(b"\r\n\r\n") + 4 :] if block else block, end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the frames' compressed and decompressed sizes, and its footer."""
    import struct

    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of an open bundle."""
    import struct

    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(size - 9 - 8 * n)
    table, at = [], 0
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        table.append((at, c, d))
        at += c
    return table


INDEX = "row long, page_id long, path string, frame int, frame_at long, frame_bytes long, offset long, length long"


def _bundler(folder: str, frame_bytes: int, level: int):
    def bundle(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        path = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        index, sizes = [], []

        def chunks():
            compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
            waiting, places, at, done, n = [], [], 0, 0, 0

            def frame():
                nonlocal waiting, places, at, done
                data = compressor.compress(b"".join(waiting))
                for row, page, offset, length in places:
                    index.append((row, page, path, len(sizes), done, len(data), offset, length))
                sizes.append((len(data), at))
                done += len(data)
                waiting, places, at = [], [], 0
                return data

            for batch in batches:
                for k in range(batch.num_rows):  # one page at a time
                    row, page_id, url, html, n_bytes, digest, refers_to, sole = (column[k].as_py() for column in batch.columns)
                    kind, n = ("response" if refers_to is None else "revisit"), n + 1
                    name = holder_name(page_id, digest) if kind == "response" and sole else f"{path}:{n}"
                    record = warc_record(page_id, url, kind, (html or "").encode(), n_bytes, digest, refers_to, name, sole)
                    places.append((row, page_id, at, len(record)))
                    waiting.append(record)
                    at += len(record)
                    if at >= frame_bytes:
                        yield frame()
            if waiting:
                yield frame()
            yield seek_table(sizes)

        put_file(path, chunks())
        columns = list(zip(*index, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
        names = [x.split()[0] for x in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return bundle


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """Add n_bytes, digest, refers_to and sole: of equal payloads of ``least`` bytes the largest id is kept.

    ``sole`` says of payloads that several rows have that one row alone has the largest id.

    The digests are counted before the join, so a payload that a third of all pages share is one row,
    and pages that have it are dealt to several tasks. Smaller payloads take no part in the join.
    """
    sized = pages.withColumn("n_bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).withColumn(
        "digest", F.sha1(F.coalesce("html", F.lit("")))
    )
    large, rest = sized.where(F.col("n_bytes") >= least), sized.where(F.col("n_bytes") < least)
    by_page = large.groupBy("digest", "n_bytes", "page_id").agg(F.count("*").alias("n_rows"))
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n_rows"))).alias("last")
    copies = by_page.groupBy("digest", "n_bytes").agg(last, F.sum("n_rows").alias("n_copies")).where("n_copies > 1 and last is not null")
    copies = copies.select("digest", "n_bytes", F.col("last.page_id").alias("holder"), (F.col("last.n_rows") == 1).alias("sole"), "n_copies")
    copies = written(copies, new_folder(pages.sparkSession, "copies"), "copies")
    refers = F.when(F.col("holder").eqNullSafe(F.col("page_id")), None).otherwise(F.col("holder"))
    found = joined(large, copies, ["digest", "n_bytes"], "n_copies", "left").withColumn("refers_to", refers).drop("holder", "n_copies")
    found = found.withColumn("sole", F.coalesce("sole", F.lit(False)))
    return found.unionByName(rest.withColumn("refers_to", F.lit(None).cast("long")).withColumn("sole", F.lit(False)))


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = 1 << 18, least: int = 1000, level: int = 3) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``; returns the index.

    Columns of the index: page_id, path, frame, frame_at and frame_bytes (the frame's place in the
    bundle), offset and length (the record's place in the decompressed frame), row (a number of the
    input row). Null html is an empty payload, a null id or url leaves out its header; of rows that
    share a page id and payload each is the response, and revisits name their page alone; all records
    have ids of their own, those of null and repeated pages too; an empty table gives no record. A
    record longer than ``frame_bytes`` has a frame of its own.
    """
    slim = pages.select("page_id", "url", "html").withColumn("row", F.xxhash64("page_id", "url"))
    ready = with_revisits(slim, least).select("row", "page_id", "url", "html", "n_bytes", "digest", "refers_to", "sole")
    return written(ready.mapInArrow(_bundler(folder, frame_bytes, level), INDEX), folder, "index")


def _reader(batches):
    import hashlib

    import pyarrow as pa
    import zstandard

    for batch in batches:
        for path, frames in zip(batch["path"].to_pylist(), batch["frames"].to_pylist(), strict=True):
            rows = []
            with open_file(path) as f:
                table = read_seek_table(f)
                for x in sorted(frames, key=lambda x: x["frame"]):
                    at, packed, size = table[x["frame"]]
                    f.seek(at)
                    data = memoryview(zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size))
                    for offset, length in sorted((y["offset"], y["length"]) for y in x["places"]):
                        headers, payload, end = parse_record(data[offset : offset + length].tobytes())
                        whole = headers["WARC-Type"] == "response"
                        number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                        rows.append(
                            {
                                "page_id": number("X-Page-Id"),
                                "payload_bytes": len(payload) if whole else number("X-Payload-Length"),
                                "payload_digest": hashlib.sha1(payload).hexdigest() if whole else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                                "record_type": headers["WARC-Type"],
                                "refers_to": number("X-Refers-To-Page-Id"),
                            }
                        )
            kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def read_records(index: DataFrame, frames_at_once: int = 64) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in the index.

    Only the frames that the index names are read, ``frames_at_once`` of a bundle in a task at most.
    """
    places = index.groupBy("path", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    frames = places.groupBy("path", F.floor(F.col("frame") / frames_at_once).alias("part")).agg(
        F.collect_list(F.struct("frame", "places")).alias("frames")
    )
    return frames.select("path", "frames").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(spark, sf_dir: str) -> DataFrame:
    """Query ``op10_seekable_bundles``: every page as its record in the archives has it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_records(write_bundles(pages, new_folder(spark, "bundles")))


ARCHIVED_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM p
"""
