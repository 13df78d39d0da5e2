"""Words of text columns read in blocks, against plain Python."""
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridlens.llm import common
from gridlens.llm import linededup as L


def _plain(texts):
    return [(r, k, w) for r, t in enumerate(texts) if t
            for k, line in enumerate(t.encode().lower().split(b"\n")) for w in line.split()]


@pytest.mark.parametrize("block", [16, 64, 1 << 18])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_in_blocks(monkeypatch, block, kind):
    monkeypatch.setattr(L, "BLOCK", block)
    common._kept.clear()
    rng = random.Random(block)
    parts = ["a", "B", "b", "é", " ", "\n", "\t", "\x00", "\x1c"]
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice([*parts, "A" * rng.randint(1, 40)])
                                                         for _ in range(rng.choice([0, 1, 5, 30, 100]))) for _ in range(rng.randint(1, 12))]
        got = [(int(r), int(k), int(h)) for row, line, hs, _ in L._words(pa.array(["zz", *texts], kind).slice(1))
               for r, k, h in zip(row, line, hs)]
        want = _plain(texts)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert len({h for *_, h in got}) == len({w for *_, w in want}) == len({(h, w) for (*_, h), (*_, w) in zip(got, want)})
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, kind)], names=["i", "t"])
        flat = []
        for doc, no, line, h in L._line_batches([batch], size=8):
            flat += zip(doc[line].tolist(), no[line].tolist(), h.tolist())
        assert flat == got
    common._kept.clear()


def test_sorted_sets_with_equal_keys():
    rng = np.random.default_rng(1)
    line = np.sort(rng.integers(0, 50, 2000))
    h = rng.integers(0, 4, 2000).astype(np.uint64) << np.uint64(40) | rng.integers(0, 4, 2000).astype(np.uint64)  # equal leading bits
    got = list(zip(*(x.tolist() for x in L._sorted_sets(line, h, np.zeros(L.COUNTERS, np.uint64)))))
    assert got == sorted(set(zip(line.tolist(), h.tolist())))


class _Here:
    """A data frame whose steps run in this process."""

    def __init__(self, batches, total=0):
        self.batches, self.total = batches, total
        self.sparkSession = self.sparkContext = self.conf = self

    def select(self, *_):
        return self

    def get(self, _):
        return "2"

    def broadcast(self, value):
        return type("Value", (), {"value": value})

    def agg(self, _):
        return self

    def first(self):
        return [self.total]

    def repartition(self, n, key):
        assert key == "bucket"
        return self

    def sortWithinPartitions(self, key):
        rows = pa.Table.from_batches(self.batches).sort_by(key)
        return _Here(rows.to_batches(max_chunksize=3))


@pytest.mark.parametrize("hot, small, threshold", [(10**9, 64, "0.8"), (10**9, 4, "0.8"), (6, 3, "0.8"), (6, 64, "0.6")])
def test_postings_in_buckets_lose_no_pair(spark, monkeypatch, hot, small, threshold):
    """Postings travel as packed buckets, not as a row each; every pair of lines that matches shares a bucket."""
    def plain_map(df, fn, schema, owner=None):
        return _Here(list(fn(iter(df.batches))))

    for name, value in {"map_batches": plain_map, "HOT": hot, "SMALL": small, "HELD": 500, "BUCKET": 40}.items():
        monkeypatch.setattr(L, name, value)
    rng = random.Random(hot + small)
    common_words = [f"w{k}" for k in range(30)]
    texts = []
    for _ in range(60):
        base = [rng.choice(common_words) if rng.random() < 0.7 else f"x{rng.random()}" for _ in range(rng.randint(1, 14))]
        texts.append("\n".join(" ".join(w for w in base if rng.random() < 0.93) for _ in range(4)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts), pa.array([0] * 60, pa.int64())], names=["i", "t", "r"])
    t = L.Fraction(threshold)
    lines = L.lines(_Here([batch]), "i", "t", np.full(L.COUNTERS, 20), t).batches
    total = sum(len(p.as_buffer()) for b in lines for p in b.column("prefix"))
    lines = [pa.RecordBatch.from_arrays([*b.columns, pa.array(range(b.num_rows))], names=[*b.schema.names, "h"]) for b in lines]
    posts = L.postings(_Here(lines, total), None)
    assert sum(b.num_rows for b in posts.batches) < total // 8 / 2
    found = {tuple(r.values())[:4] for b in L.candidates(posts, t, 10**6).batches for r in b.to_pylist()}
    sets = [((d, k), set(line.split())) for d, text in enumerate(texts) for k, line in enumerate(text.split("\n")) if line.split()]
    want = {(*b, *a) for i, (b, y) in enumerate(sets) for a, x in sets[:i] if len(x & y) >= t * len(x | y)}
    assert want and want <= found and all(b[:2] > b[2:] for b in found)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_lines_of_texts_by_column(kind):
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "B", "\n", "é", " "]) for _ in range(rng.choice([0, 1, 4, 9]))) for _ in range(300)]
    got, (row, no) = L._split(pa.array(["zz\n", *texts], kind).slice(1))
    got = [(int(r), int(k), line.removesuffix("\n")) for r, k, line in zip(row, no, got.to_pylist())]
    assert got == [(r, k, line) for r, text in enumerate(texts) for k, line in enumerate((text or "").split("\n"))]
    assert len(L._split(pa.array([], kind))[0]) == 0


def test_hash_of_longs_as_in_spark():
    doc, line = np.array([0, 5, -1 << 63, (1 << 62) + 7]), np.array([0, 1, 3 << L.LINE_BITS, 77])
    assert L._hash_long(line, L._hash_long(doc, np.uint64(42))).tolist() == [
        xxhash.xxh64_intdigest(int(k).to_bytes(8, "little"), xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), 42))
        for d, k in zip(doc, line)]
