"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: words are runs of anything but ASCII white space, A-Z lower-cased;
each shingle of ``shingle`` words (fewer words: the whole sequence) is hashed by
64-bit xxHash; a bit of the fingerprint is 1 if it is set in over half the
hashes, repeats included.  A text without words has fingerprint zero.

Links: two fingerprints at ``radius`` or fewer differing bits.  Bits are cut into
``radius + 2`` blocks; two linked fingerprints agree on at least two of them, so
every link is found in a bucket keyed by some pair of blocks.
In a bucket, fingerprints are stored as vertical bit planes; one pass over the planes
updates the distances to 64 candidates a word with carry-save counters, and
stops for a block once all its distances exceed the radius.

Equal fingerprints are merged before anything is compared.  A bucket of more
than ``BLOCK`` fingerprints is split into blocks, and each pair of blocks is its own
unit of work, so a hot bucket spreads over tasks.  A bucket sends on
only a spanning forest of its links, which keeps every component whole.

Null texts have no words.  Rows with equal ids are separate rows with the same label rules.
Null ids never become a component's id unless the component has no other.  Empty
input gives no rows.  Columns other than the two named are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, map_batches, map_rows, own_rows, store

BLOCK = 4096
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i:i + shingle]), seed) for i in range(n)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[k:k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(rows):
        for i, text in rows:
            v = fingerprint(text, shingle, seed)
            yield i, v - (1 << 64) if v >> 63 else v

    return map_rows(df.select(id_col, text_col), run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row p holds bit p of all fingerprints, 64 to a word."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _near(diffs, width: tuple, radius: int) -> np.ndarray:
    """Bits of the positions whose count of set planes stays within the radius.

    ``diffs`` yields planes of differing bits.  Carry-save: the counters are
    themselves bit planes; a carry out of the last one is sticky."""
    levels = (radius + 1).bit_length()
    start = (1 << levels) - radius - 1  # counting from here overflows beyond the radius
    count = [np.full(width, _ONES if start >> k & 1 else 0, np.uint64) for k in range(levels)]
    over = np.zeros(width, np.uint64)
    for p, d in enumerate(diffs):
        for k in range(levels):
            d, count[k] = count[k] & d, count[k] ^ d
        over |= d
        if p % 8 == 7 and (over == _ONES).all():
            return np.zeros(width, np.uint64)
    return ~over


def block_links(a: np.ndarray, b: np.ndarray, radius: int):
    """(i, j) index arrays of all links between two blocks of fingerprints."""
    right = planes(b)
    at_i, at_j = [], []
    for k in range(0, len(a), 256):
        q = a[k:k + 256]
        mask = (np.unpackbits(q.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64) * _ONES)
        near = _near((right[p][None, :] ^ mask[p][:, None] for p in range(64)), (len(q), right.shape[1]), radius)
        if near.any():
            hit = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little")[:, :len(b)]
            i, j = np.nonzero(hit)
            at_i.append(i + k)
            at_j.append(j)
    if not at_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(at_i), np.concatenate(at_j)


def lag_links(fps: np.ndarray, run: np.ndarray, radius: int):
    """(i, j) of all links inside short runs of one sorted array: each row
    against the row ``lag`` places on, as long as any run is that long."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at_i, at_j, lag = [], [], 1
    i = np.flatnonzero(run[1:] == run[:-1])
    while len(i):
        pad = -len(i) % 64
        x = np.pad(bits[i] ^ bits[i + lag], ((0, pad), (0, 0)))
        vertical = np.ascontiguousarray(np.packbits(x.T, axis=1, bitorder="little")).view(np.uint64)
        near = _near(vertical, (vertical.shape[1],), radius)
        hit = i[np.unpackbits(near.view(np.uint8), bitorder="little")[:len(i)].astype(bool)]
        at_i.append(hit)
        at_j.append(hit + lag)
        lag += 1
        i = i[i + lag < len(run)]
        i = i[run[i] == run[i + lag]]
    if not at_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(at_i), np.concatenate(at_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links (i, j): the root of each node, by repeated minimum."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_keys(radius: int) -> list[tuple[int, str]]:
    """(table number, SQL of its key) for each pair of bit blocks."""
    blocks = radius + 2
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(blocks)]
    out = []
    for t, (a, b) in enumerate(itertools.combinations(range(blocks), 2)):
        m = masks[a] | masks[b]
        out.append((t, m - (1 << 64) if m >> 63 else m))
    return out


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): a spanning forest of the links of each bucket; ``fps`` (fp) distinct."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                       for t, m in _bucket_keys(radius)])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    # buckets of one fingerprint hold no link; large ones are split into blocks
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    work = keyed.join(sizes, ["t", "key"]).withColumn("s", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn(
        "me", F.pmod(F.xxhash64("fp", "t"), F.col("s")).cast("int"))
    work = work.select("t", "key", "fp", "me", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
    work = work.select("t", "key", "fp", "me", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        held, size = [], 0
        for b in it:
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                  for c in ("t", "key", "lo", "hi", "me", "fp")], 1))
            size += len(held[-1])
            if size >= 1 << 16:
                rows = np.concatenate(held)
                # the last unit may go on in the next batch
                cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))
                at = int(cut[-1]) + 1 if len(cut) else 0
                yield from pairs(rows[:at])
                held, size = [rows[at:]], len(rows) - at
        if held:
            yield from pairs(np.concatenate(held))

    def pairs(rows):
        if not len(rows):
            return
        fp = np.ascontiguousarray(rows[:, 5])
        u = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(1)]))
        ends = np.append(starts[1:], len(rows))
        run_of = np.repeat(np.arange(len(starts)), ends - starts)
        short = (ends - starts) <= 64
        at_i, at_j = [], []
        pick = np.flatnonzero(short[run_of] & (rows[:, 2] == rows[:, 3]))
        if len(pick):
            i, j = lag_links(u[pick], run_of[pick], radius)
            at_i.append(pick[i])
            at_j.append(pick[j])
        for k in np.flatnonzero(~short | (rows[starts, 2] != rows[starts, 3])).tolist():
            s, e = int(starts[k]), int(ends[k])
            if rows[s, 2] == rows[s, 3]:
                i, j = block_links(u[s:e], u[s:e], radius)
                i, j = i + s, j + s
            else:  # rows are sorted by block, lower first
                m = s + int((rows[s:e, 4] == rows[s, 2]).sum())
                i, j = block_links(u[s:m], u[m:e], radius)
                i, j = i + s, j + m
            at_i.append(i)
            at_j.append(j)
        if not at_i:
            return
        root = forest(len(rows), np.concatenate(at_i), np.concatenate(at_j))
        got = np.flatnonzero(root != np.arange(len(rows)))
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(fp[root[got]]), pa.array(fp[got])], schema=schema)

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = work.repartition(n, "t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "me", "fp")
    return map_batches(ordered, run, schema)


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, label, component_id) of the fingerprints in ``rows`` (id, fp)."""
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected_components(links(least.select("fp"), radius))
    of_fp = least.join(labels, least.fp == labels.v, "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = of_fp.groupBy("label").agg(F.min("least").alias("component_id"))
    return of_fp.join(ids, "label").select("fp", "label", "component_id")


def components(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id): the least id reachable over links, for every row."""
    rows = store(fingerprints(df, id_col, text_col, shingle, seed), "simhash")
    return rows.join(_labelled(rows, radius), "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The rows that stay when each component keeps one document, all columns
    unchanged: the one with the least id, of rows with equal ids the first by
    text; in a component without ids, the first by text."""
    rows = store(fingerprints(df, id_col, text_col, shingle, seed), "simhash")
    labels = store(_labelled(rows, radius), "simhash-labels")
    single, many = own_rows(df, id_col, text_col)
    ids = labels.where("component_id is not null").select(F.col("component_id").alias("__id")).distinct()
    stays = single.join(ids, F.col(id_col) == F.col("__id"), "left_semi")
    if many is None:
        return stays
    # rows that share an id are found again by their fingerprint
    many = many.drop("__row")
    at, out = many.columns.index(text_col), StructType([*many.schema, StructField("__fp", LongType())])

    def mark(it):
        for b in it:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, "__fp"])

    of_fp = labels.select(F.col("fp").alias("__fp"), F.col("label").alias("__label"), F.col("component_id").alias("__id"))
    loose = map_batches(many, mark, out).join(of_fp, "__fp").where(F.col(id_col).eqNullSafe(F.col("__id")))
    one = F.row_number().over(Window.partitionBy("__label").orderBy(text_col))
    return stays.unionByName(loose.withColumn("__rank", one).where("__rank = 1").select(*df.columns))
