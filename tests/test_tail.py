"""Growing files: what each batch reads, replaced and vanished files, failures, many files."""

import os
import random
import time
from collections import Counter

import pytest

from meterloom.sources import tail
from meterloom.sources.tail import Tail


def lines_of(t, first=0):
    return Counter((os.path.basename(r["file"]), r["pos"], r["line"]) for r in t.lines(first).collect())


def written(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def test_files_that_grow(spark, tmp_path):
    """Unterminated lines, CR LF, empty files, spans within lines, files in subfolders and without change."""
    root, folder = tmp_path / "in", str(tmp_path / "t")
    assert not Tail(spark, str(root), folder).step()
    (root / "sub").mkdir(parents=True)
    a, b = root / "a.jsonl", root / "sub" / "b.jsonl"
    written(a, "one\nzweiter é\r\n\nunterminated".encode())
    written(b, b"")
    written(root / "other.txt", b"no\n")
    t = Tail(spark, str(root), folder, span=4)
    assert t.step() and not t.step()
    assert lines_of(t) == {("a.jsonl", 0, "one"): 1, ("a.jsonl", 4, "zweiter é"): 1, ("a.jsonl", 16, ""): 1}
    written(a, b" no more\nand on")
    written(b, b"x\n" * 5)
    assert Tail(spark, str(root), folder, span=4).step()
    t = Tail(spark, str(root), folder)
    assert lines_of(t, 1) == {("a.jsonl", 17, "unterminated no more"): 1} | {("b.jsonl", 2 * i, "x"): 1 for i in range(5)}
    b.unlink()
    assert t.step() and not t.step() and not lines_of(t, 2)


def test_replaced_files(spark, tmp_path):
    """Shorter or longer, a file with another beginning is read anew; one that only grew is not."""
    root, folder = tmp_path / "in", str(tmp_path / "t")
    root.mkdir()
    for name in ("longer", "shorter", "same", "grown"):
        written(root / f"{name}.jsonl", f"first of {name}\nsecond\n".encode())
    t = Tail(spark, str(root), folder)
    assert t.step()
    written(root / "longer.jsonl", b"another beginning\nand more lines\nthan before\n", "wb")
    written(root / "shorter.jsonl", b"brief\n", "wb")
    written(root / "grown.jsonl", b"third\n")
    os.utime(root / "same.jsonl", (time.time() + 9, time.time() + 9))
    assert t.step() and not t.step()
    assert lines_of(t, 1) == {("longer.jsonl", 0, "another beginning"): 1, ("longer.jsonl", 18, "and more lines"): 1, ("longer.jsonl", 33, "than before"): 1, ("shorter.jsonl", 0, "brief"): 1, ("grown.jsonl", 22, "third"): 1}


def test_batches_of_bounded_bytes(spark, tmp_path):
    """Every file gets its share of a batch; a line longer than that is read whole; a failed batch is read again."""
    rng, root, folder = random.Random(1), tmp_path / "in", str(tmp_path / "t")
    root.mkdir()
    want = Counter()
    for i in range(6):
        at = 0
        for k in range(rng.randrange(1, 30)):
            line = f"{i}-{k}-" + "x" * rng.choice([0, 3, 200])
            want[f"f{i}.jsonl", at, line] += 1
            written(root / f"f{i}.jsonl", f"{line}\n".encode())
            at += len(line) + 1
    t = Tail(spark, str(root), folder, most_bytes=1200)
    assert t.step()
    first = lines_of(t)
    assert len({f for f, _, _ in first}) == 6 and sum(len(x) + 1 for _, _, x in first) < 1200 + 6 * 210
    put, tail.put_text = tail.put_text, None
    try:
        with pytest.raises(TypeError):
            Tail(spark, str(root), folder, most_bytes=1200).step()
    finally:
        tail.put_text = put
    t = Tail(spark, str(root), folder, most_bytes=1200)
    while t.step():
        pass
    assert lines_of(t) == want and t.manifest["batches"] > 2


def test_many_files(spark, tmp_path):
    """Some thousand files in many folders: one batch, a manifest of fixed size, and only what changed is opened again."""
    root, folder = tmp_path / "in", str(tmp_path / "t")
    for i in range(2000):
        (root / f"d{i % 50}").mkdir(parents=True, exist_ok=True)
        written(root / f"d{i % 50}" / f"{i}.jsonl", f"line of {i}\n".encode())
    t = Tail(spark, str(root), folder)
    assert t.step() and t.lines().count() == 2000
    manifest = max((tmp_path / "t" / "_manifests").glob("*.json"))
    assert manifest.stat().st_size < 60
    written(root / "d7" / "7.jsonl", b"more\n")
    assert t.step() and lines_of(t, 1) == {("7.jsonl", 10, "more"): 1}


def test_tail_as_a_stream(spark, tmp_path):
    root, folder = tmp_path / "in", str(tmp_path / "t")
    root.mkdir()
    written(root / "a.jsonl", b"one\n")
    query = tail.tail_stream(spark, str(root), folder, str(tmp_path / "cp"), seconds=1)
    try:
        for n in (1, 2):
            until = time.time() + 90
            while Tail(spark, str(root), folder).manifest["batches"] < n and time.time() < until:
                time.sleep(0.5)
            written(root / "a.jsonl", b"two\n")
    finally:
        query.stop()
    assert set(lines_of(Tail(spark, str(root), folder))) >= {("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")}
