"""Benchmark decontamination with a distributed positional inverted index.

Words: A-Z lower-cased, then runs of ASCII letters, digits and all non-ASCII characters.

The index is sharded by document, as search engines do: each shard (a few MB
of whole documents) stores, for every term it holds, the ascending list of its
positions.  Terms that no test item has can match nothing, so an index made
for one benchmark leaves them out (``vocabulary=None`` keeps all).

Search: a test item becomes windows of ``window`` consecutive words (one
window if it is shorter).  In each shard a window starts from its rarest term;
the position lists of its other terms, moved by their offsets, are intersected in
order of rarity until none is left (exact phrases).  Proximity matches come from
the same lists with a tolerance of ``slop`` words for each offset.

The test side is sent to the tasks in blocks of at most ``block_bytes`` of text; a larger
benchmark takes several passes over the stored index, so nothing grows without bound.  Documents are never
shuffled, hence a hot source, a passage shared by a third of them or a
very long text only costs its own length.

Null and empty texts have no words; null and empty items match nothing; equal items are
all reported; a null item id is not listed.  Rows with equal document ids are separate documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_batches, map_rows, own_rows, store

SHARD_BYTES = 4 << 20
#: unused places between documents of a shard; windows and slop must stay below it
GAP = 64


def _fold() -> bytes:
    """Byte table: word bytes stay (A-Z lower-cased), all others become spaces."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


_FOLD = _fold()


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


INDEX = pa.schema([
    ("shard", pa.string()),
    ("docs", pa.list_(pa.int64())),      # documents of the shard
    ("lengths", pa.list_(pa.int64())),   # their word counts
    ("terms", pa.list_(pa.binary())),
    ("counts", pa.list_(pa.int32())),    # postings of each term
    ("positions", pa.binary()),          # int32, term after term; a gap parts documents
])


def build_index(df: DataFrame, id_col: str, text_col: str, vocabulary: set[bytes] | None) -> DataFrame:
    """Positional postings of all documents, one row per shard.

    Positions count through a shard with ``GAP`` unused places after each document,
    so that no phrase or proximity window crosses documents."""
    spark = df.sparkSession
    known = spark.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(rows):
        keep = known.value if known is not None else None
        number: dict[bytes, int] = {}
        if keep is not None:
            number = {t: k for k, t in enumerate(sorted(keep))}
        get = number.get
        docs, lengths, ids, at, size, offset = [], [], [], [], 0, 0
        part, made = TaskContext.get().partitionId(), 0

        def shard():
            where = np.concatenate(at) if at else np.zeros(0, np.int32)
            term = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable")
            found, counts = np.unique(term, return_counts=True)
            names = list(number)
            return f"{part}-{made}", docs, lengths, [names[t] for t in found.tolist()], counts.tolist(), where[order].astype("<i4").tobytes()

        for doc, text in rows:
            w = words(text)
            if keep is None:
                got = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int32, len(w))
                hit = np.arange(len(w), dtype=np.int32)
            else:
                got = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
                hit = np.flatnonzero(got >= 0).astype(np.int32)
                got = got[hit]
            docs.append(doc)
            lengths.append(len(w))
            ids.append(got)
            at.append(hit + np.int32(offset))
            offset += len(w) + GAP
            size += len(text or "")
            if size >= SHARD_BYTES or len(docs) >= 1 << 16:
                yield shard()
                docs, lengths, ids, at, size, offset = [], [], [], [], 0, 0
                made += 1
                if keep is None:
                    number.clear()
        if docs:
            yield shard()

    return map_rows(df.select(id_col, text_col), run, INDEX)


def windows_of(items: list[tuple], window: int) -> list[tuple[str, tuple[bytes, ...]]]:
    out = []
    for item, text in items:
        w = words(text)
        if w:
            out += [(item, tuple(w[k:k + window])) for k in range(max(1, len(w) - window + 1))]
    return out


def _search(terms, counts, positions, queries, slop: int):
    """For each distinct window found: (query number, exact starts, proximity starts)."""
    ends = np.cumsum(counts)
    lists = {t: positions[e - c:e] for t, c, e in zip(terms, counts, ends.tolist())}
    empty = np.zeros(0, np.int32)
    for k, q in enumerate(queries):
        got = [lists.get(t) for t in q]
        order = sorted(range(len(q)), key=lambda i: len(got[i]))
        first = order[0]
        near = exact = got[first] - np.int32(first)
        for i in order[1:]:
            p = got[i]
            target = exact + np.int32(i)
            if len(exact):
                j = np.searchsorted(p, target)
                exact = exact[(j < len(p)) & (p[np.minimum(j, len(p) - 1)] == target)]
            if slop and len(near):
                j = np.searchsorted(p, near + np.int32(i - slop))
                near = near[(j < len(p)) & (p[np.minimum(j, len(p) - 1)] <= near + np.int32(i + slop))]
            elif not len(exact):
                break
        if len(exact) or (slop and len(near)):
            yield k, exact, near if slop else empty


FOUND = pa.schema([("row", pa.string()), ("doc", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                   ("near_items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])


def search(index: DataFrame, queries: list[tuple[str, tuple[bytes, ...]]], slop: int = 0) -> DataFrame:
    """One row per document of the index.

    spans: first and end word of each maximal run of hit words, flattened;
    near_items: items with all words of a window within ``slop`` places of an exact match's."""
    by_window: dict[tuple[bytes, ...], set] = {}
    for item, w in queries:
        by_window.setdefault(w, set())
        if item is not None:
            by_window[w].add(item)
    shared = index.sparkSession.sparkContext.broadcast(list(by_window.items()))

    def run(it):
        known = shared.value
        wanted = [w for w, _ in known]

        def rows():
            for b in it:
                for name, docs, lengths, terms, counts, raw in zip(*(c.to_pylist() for c in b.columns)):
                    yield from shard(name, docs, lengths, terms, counts, np.frombuffer(raw, "<i4"))

        def shard(name, docs, lengths, terms, counts, positions):
            have = set(terms)
            n = np.array(lengths, np.int64)
            gap_starts = np.cumsum(n + GAP) - (n + GAP)
            total = int(gap_starts[-1] + n[-1] + GAP)
            edge = np.zeros(total + 1, np.int32)
            items: dict[int, set] = {}
            near_items: dict[int, set] = {}
            live = [k for k, w in enumerate(wanted) if have.issuperset(w)]
            for k, exact, near in _search(terms, counts, positions, [wanted[k] for k in live], slop):
                w, ids = known[live[k]]
                if len(exact):
                    np.add.at(edge, exact, 1)
                    np.add.at(edge, exact + len(w), -1)
                    for d in np.unique(np.searchsorted(gap_starts, exact, side="right") - 1).tolist():
                        items.setdefault(d, set()).update(ids)
                for d in np.unique(np.searchsorted(gap_starts, near, side="right") - 1).tolist():
                    near_items.setdefault(d, set()).update(ids)
            hit = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            sums = np.concatenate([[0], np.cumsum(hit)])
            first = np.searchsorted(turn, gap_starts)
            for d, (doc, m, s) in enumerate(zip(docs, lengths, gap_starts.tolist())):
                last = first[d + 1] if d + 1 < len(first) else len(turn)
                yield (f"{name}-{d}", doc, m, int(sums[s + m] - sums[s]), sorted(items.get(d, ())), sorted(near_items.get(d, ())),
                       (turn[first[d]:last] - s).tolist())

        yield from batches(FOUND, rows())

    return map_batches(index, run, FOUND)


def find(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
         window: int = 10, slop: int = 1, block_bytes: int = 16 << 20) -> DataFrame:
    """(row, doc, n_words, n_hit, items, near_items, spans) for every document."""
    if window + slop >= GAP:
        raise ValueError(f"window and slop must stay below {GAP}")
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-size // block_bytes))
    out = None
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else rows
        queries = windows_of([(r["i"], r["t"]) for r in block.collect()], window)  # one block's texts
        vocabulary = {t for _, w in queries for t in w}
        index = store(build_index(docs, id_col, text_col, vocabulary), "index")
        found = search(index, queries, slop)
        out = found if out is None else out.unionByName(found)
    if parts == 1:
        return out
    return merge(out)


def merge(found: DataFrame) -> DataFrame:
    """One row per document from several blocks of items: hit words are united."""
    grouped = found.groupBy("row", "doc", "n_words").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
                                                    for c in ("items", "near_items")], F.collect_list("spans").alias("s"))

    def run(rows):
        for row, doc, n, items, near, many in rows:
            ranges = sorted((s[i], s[i + 1]) for s in many for i in range(0, len(s), 2))
            out: list[int] = []
            for a, b in ranges:
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            yield row, doc, n, sum(out[1::2]) - sum(out[::2]), items, near, out

    return map_rows(grouped.select("row", "doc", "n_words", "items", "near_items", "s"), run, FOUND)


def drop_contaminated(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
                      window: int = 10) -> DataFrame:
    """The rows without any benchmark window, all columns unchanged; each row is judged by its own text."""
    def clean(rows, key):
        found = find(rows, key, text_col, benchmark, item_col, item_text, window, slop=0)
        bad = found.where("n_hit > 0").select(F.col("doc").alias("__doc")).distinct()
        return rows.join(bad, F.col(key) == F.col("__doc"), "left_anti")

    single, many = own_rows(docs, id_col, text_col)
    out = clean(single, id_col)
    return out if many is None else out.unionByName(clean(many, "__row").drop("__row"))
