"""Line dedup by an exact set-similarity join.

A line (split at ``\\n``) with at least one word is compared as the set of its
words (runs of anything but ASCII white space, A-Z lower-cased).  It is removed when an
earlier line, in (document id, line number) order over the whole table, has
a Jaccard similarity of ``threshold`` or more with it.  Lines are judged on the
input, so a removed line still removes later ones.  Lines without words stay.

Steps:
1. Rarity: lines' words are counted in a table of 2^18 hashed counters, a fixed
   size for any corpus; words are ordered by (count in steps of 2^(1/16), hash).  Any
   fixed order gives the same result, a good one gives short candidate lists.
2. Lines with equal sets form a class; only its first line goes on.
3. The first ``n - ceil(t n) + 1`` words of a line in that order (its prefix)
   become postings.  Two lines that match share a prefix word.  Postings travel in
   buckets by word, packed column by column, and are sorted a bucket at a time.
4. Lines that share a prefix word are compared by length, by the position of the
   word, and by the 128 parity bits of their sets (a bound on the symmetric difference);
   the first candidates before each line are verified exactly on the
   words.  A line none of whose first candidates holds, but which has more,
   gets all the rest in a second round.  Hot prefix words are split into blocks, and
   each pair of blocks is a unit of work.
5. Every line of a class that matched an earlier class, and every line but the first
   of any class, is a later match.

Null texts have no lines.  A null id sorts before all others.  Rows that share an id, or
have none, are documents of their own, in the order of their texts' hashes: each has a
number (``common.own_rows``) that the line numbers inside carry in their upper bits.
Only the named columns are read; ``apply`` keeps all columns of its input.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, batches, kept, map_batches, map_rows, own_rows, store

COUNTERS = 1 << 18
FLAGS = 1 << 22
HOT = 100_000
FIRST = 2
SMALL = 64
BLOCK = 1 << 16
#: postings that a task holds before it deals them into buckets, and postings that a bucket has about
HELD = 1 << 19
BUCKET = 1 << 17
BASE = 0x9FB21C651E98DF25
#: prefix words keep the upper 40 bits of their hash: words that meet there only add candidates
WORD = ~np.uint64((1 << 24) - 1)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
#: byte -> A-Z lower-cased, plus one
_VALUE = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1)
#: lower bits of a line column: the line's number in its row; upper bits: the row's among those that share ids
LINE_BITS = 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _add_up(rows: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Sum of (chunk, counts) rows; the result has a fixed size."""
    schema = pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])

    def run(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for k, raw in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                x = np.frombuffer(raw, dtype)
                total[k] = total[k] + x if k in total else x.copy()
        yield from batches(schema, ((k, x.tobytes()) for k, x in total.items()))

    out = np.zeros(size, dtype)
    part = size // 16
    for r in map_batches(rows.repartition(16, "chunk"), run, schema).collect():
        out[r["chunk"] * part:(r["chunk"] + 1) * part] = np.frombuffer(r["counts"], dtype)
    return out


def _chunks(total: np.ndarray):
    part = len(total) // 16
    for k in range(16):
        piece = total[k * part:(k + 1) * part]
        if piece.any():
            yield k, piece.tobytes()


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(BLOCK, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


def _block_words(data: np.ndarray, rows: np.ndarray, placed: bool = True) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """(row, line, hash) of each word in a block of bytes; rows: where each row starts.  Not placed: only hashes.

    A word's hash is a polynomial of its bytes: differences of one running sum."""
    power, inverse = kept(_powers, _powers)
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    cuts = rows[(rows > 0) & (rows < len(data))]  # words end at a row's end
    first[cuts] = ~space[cuts]
    last[cuts - 1] = ~space[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    run = np.append(np.uint64(0), np.cumsum(_VALUE[data] * power[:len(data)]))
    h = _mix((run[end + 1] - run[start]) * inverse[start])
    if not placed:
        return None, None, h
    newlines = np.flatnonzero(data == 10)
    row = np.searchsorted(rows, start, "right") - 1
    return row, np.searchsorted(newlines, start) - np.searchsorted(newlines, rows)[row], h


def _words(column: pa.Array, placed: bool = True):
    """(row, line number, hash, whether the last row is complete) of a text column's words,
    a bounded block at a time, however long a row.  Not placed: only hashes, where that is less work."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = "<i8" if pa.types.is_large_string(column.type) else "<i4"
    at = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k, n = 0, len(column)
    while k < n:
        m = int(np.searchsorted(at, at[k] + BLOCK, "right")) - 1
        if m > k:
            row, line, h = _block_words(data[at[k]:at[m]], at[k:m] - at[k], placed)
            yield row + k if placed else None, line, h, True
            k = m
            continue
        a, b, line = int(at[k]), int(at[k + 1]), 0
        while a < b:
            c = min(b, a + BLOCK)
            spaces = np.flatnonzero(_SPACE[data[a:c]]) if c < b else None
            if c == b or len(spaces):
                c = c if c == b else a + int(spaces[-1]) + 1
                got, no, h = _block_words(data[a:c], np.zeros(1, np.int64))
                yield got + k, no + line, h, c == b
                line += int((data[a:c] == 10).sum())
            else:
                c, h = _long_word(data, a, b)
                yield np.array([k]), np.array([line]), h, c == b
            a = c
        k += 1


def _long_word(data: np.ndarray, a: int, b: int) -> tuple[int, np.ndarray]:
    """(end, hash) of the word from a, longer than a block: the same polynomial, block by block."""
    power, total, c, more = kept(_powers, _powers)[0], 0, a, True
    while more and c < b:
        part = data[c:min(b, c + BLOCK)]
        spaces = np.flatnonzero(_SPACE[part])
        if len(spaces):
            part, more = part[:spaces[0]], False
        total += int((_VALUE[part] * power[:len(part)]).sum()) * pow(BASE, c - a, 1 << 64)
        c += len(part)
    return c, _mix(np.array([total % (1 << 64)], np.uint64))


def _line_batches(batches_, size: int = 1 << 16):
    """(document, line number, line of each word counted from 0, hash) of many whole lines at once;
    a third column numbers the rows."""
    for b in batches_:
        ids = b.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        rows = b.column(2).to_numpy() << LINE_BITS if b.num_columns > 2 else np.zeros(len(ids), np.int64)
        held, n = [], 0
        for row, line, h, whole in _words(b.column(1)):
            held.append((row, line, h))
            n += len(h)
            if n < size:
                continue
            row, line, h = (np.concatenate(x) for x in zip(*held))
            cut = n if whole else int(np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])))[-1])
            if cut:
                yield _grouped(ids, rows, row[:cut], line[:cut], h[:cut])
            held, n = [(row[cut:], line[cut:], h[cut:])], n - cut
        if n:
            yield _grouped(ids, rows, *(np.concatenate(x) for x in zip(*held)))


def _grouped(ids, rows, row, line, h):
    new = np.append(True, (row[1:] != row[:-1]) | (line[1:] != line[:-1]))
    return ids[row[new]], line[new] + rows[row[new]], np.cumsum(new) - 1, h


def _sorted_sets(line: np.ndarray, h: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each line's distinct words in the order (rarity class, hash)."""
    q = rare[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
    # line, class and leading hash bits in one key; lines in a batch number below 2^20
    key = line.astype(np.uint64) << np.uint64(44) | q << np.uint64(34) | h >> np.uint64(30)
    order = np.argsort(key)
    k, g, w = key[order], line[order], h[order]
    same = k[1:] == k[:-1]
    if (same & (w[1:] != w[:-1])).any():
        order = np.lexsort((h, q, line))
        g, w = line[order], h[order]
        same = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
    keep = np.append(True, ~same)
    return g[keep], w[keep]


def rarity(docs: DataFrame, text_col: str) -> np.ndarray:
    """Hashed word counts over all texts."""
    def run(it):
        total, held = np.zeros(COUNTERS, np.int64), []
        for b in it:
            for _, _, h, _ in _words(b.column(0), False):
                held.append((h & np.uint64(COUNTERS - 1)).astype(np.int64))
                if sum(map(len, held)) >= 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        yield from batches(schema, _chunks(total))

    schema = pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])
    return _add_up(map_batches(docs.select(text_col), run, schema), COUNTERS, "<i8")


def _pack(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of runs of 64-bit integers."""
    offsets = np.append(0, np.cumsum(lengths) * 8).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths): the inverse of ``_pack``."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]].tobytes() if data is not None else b""
    return np.frombuffer(raw, "<i8"), np.diff(at) // 8


def lines(docs: DataFrame, id_col: str, text_col: str, counts: np.ndarray, threshold: Fraction) -> DataFrame:
    """(doc, line, hi, lo, size, parity, half, prefix, blocks): one row per line with words.

    parity: of the set's words by 64 hashed places; half: of one half of the words;
    hi, lo: 128-bit hash of the set; prefix: word hashes, packed; blocks: their
    block counts, packed, empty where all are 1."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float64))  # 2 MB, fixed
    schema = pa.schema([("doc", pa.int64()), ("line", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                        ("size", pa.int32()), ("parity", pa.int64()), ("half", pa.int64()),
                        ("prefix", pa.binary()), ("blocks", pa.binary())])

    num, den = threshold.numerator, threshold.denominator

    def run(it):
        count = shared.value
        rare = np.minimum(1023, np.log2(count + 1) * 16).astype(np.uint64)
        for doc, no, line, h in _line_batches(it):
            line, h = _sorted_sets(line, h, rare)
            starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            size = np.diff(np.append(starts, len(h)))
            # order does not matter to these sums, so equal sets get equal pairs
            hi = np.add.reduceat(_mix(h), starts).view(np.int64)
            lo = np.add.reduceat(_mix(h ^ np.uint64(0x9E3779B97F4A7C15)), starts).view(np.int64)
            bit = np.uint64(1) << (h >> np.uint64(58))
            parity = np.bitwise_xor.reduceat(bit, starts).view(np.int64)
            half = np.bitwise_xor.reduceat(bit * (h >> np.uint64(57) & np.uint64(1)), starts).view(np.int64)
            prefix = size - -(-num * size // den) + 1          # n - ceil(t n) + 1
            first = np.arange(len(h)) - np.repeat(starts, size) < np.repeat(prefix, size)
            take = h[first]
            blocks = np.maximum(1, np.ceil(count[(take % np.uint64(COUNTERS)).astype(np.int64)] / HOT)).astype("<i8")
            hot = np.maximum.reduceat(blocks, np.cumsum(prefix) - prefix) > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(no), pa.array(hi), pa.array(lo), pa.array(size.astype(np.int32)), pa.array(parity),
                 pa.array(half), _pack(take & WORD, prefix), _pack(blocks[np.repeat(hot, prefix)], np.where(hot, prefix, 0))], schema=schema)

    return map_batches(docs.select(id_col, text_col, "__row"), run, schema)


#: a posting's numbers; shape: size << 16 | position of the word, at most 2^16 - 1 (less only weakens the positional filter)
POSTING = ("unit", "word", "parity", "half", "doc", "line", "shape")
#: postings of a bucket and task, packed column by column; ``candidates`` sorts a bucket at a time
POSTINGS = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])


def postings(classes: DataFrame, words: np.ndarray | None = None, open_lines: np.ndarray | None = None) -> DataFrame:
    """A posting per prefix word of each class's first line, and per unit of a hot word, in
    buckets by (word, unit).

    unit: block pair (lo << 33 | hi << 2) and which of the two the row is in.
    With bit tables: only the words that one has (and some others); bit 1 of the
    unit marks rows whose line is in the other."""
    spark = classes.sparkSession
    flags = None
    if words is not None:
        flags = spark.sparkContext.broadcast((words, open_lines))  # 1 MB, fixed
    total = classes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * BUCKET)))

    def has(table, k):
        return (table[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)

    def rows(it):
        """(unit, word, line's place, word's place, lines) of postings, a bounded number at a time."""
        for b in it:
            doc, line, size, parity, half, h = (b.column(c).to_numpy() for c in ("doc", "line", "size", "parity", "half", "h"))
            words, length = _unpack(b.column("prefix"))
            blocks, hot = _unpack(b.column("blocks"))
            row = np.repeat(np.arange(len(doc)), length)
            at = np.arange(len(words)) - np.repeat(np.cumsum(length) - length, length)
            split = np.ones(len(words), np.int64)
            split[np.repeat(hot > 0, length)] = blocks
            mark = np.zeros(len(doc), np.int64)
            if flags is not None:
                some, open_ = flags.value
                mark = has(open_, h % FLAGS).astype(np.int64) << 1
                wanted = has(some, _place(words))
                words, row, at, split = words[wanted], row[wanted], at[wanted], split[wanted]
            lines_ = np.stack([parity, half, doc, line, size.astype(np.int64) << 16])
            ends = np.cumsum(split)
            k = 0
            while k < len(words):
                m = max(k + 1, int(np.searchsorted(ends, ends[k] + (1 << 16))))
                s = split[k:m]
                i = np.repeat(np.arange(k, m), s)
                r = row[i]
                other = np.arange(len(i)) - np.repeat(np.cumsum(s) - s, s)
                me = (doc[r] * 1_000_003 + line[r]) % split[i]
                lo, hi = np.minimum(me, other), np.maximum(me, other)
                unit = lo << 33 | hi << 2 | ((me == hi) & (lo != hi)) | mark[r]
                yield unit, words[i], r, at[i], lines_
                k = m

    def packed(held):
        """Held postings by bucket, in batches of bounded size."""
        unit, word, row, at, tables = zip(*held)
        new = [k for k in range(len(tables)) if not k or tables[k] is not tables[k - 1]]
        base = np.cumsum([0] + [tables[k].shape[1] for k in new])
        row = np.concatenate([r + base[bisect_right(new, k) - 1] for k, r in enumerate(row)])
        unit, word, at, lines_ = np.concatenate(unit), np.concatenate(word), np.concatenate(at), np.concatenate([tables[k] for k in new], 1)
        key = _mix(word.view(np.uint64) ^ _mix((unit >> 2).view(np.uint64))) % np.uint64(buckets)
        order = np.argsort(key)
        x, key, row = np.empty((len(POSTING), len(order)), np.int64), key[order].astype(np.int64), row[order]
        x[0], x[1] = unit[order], word[order]
        for k, column in enumerate(lines_, 2):
            column.take(row, out=x[k], mode="clip")
        x[6] |= np.minimum(at[order], 0xFFFF)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for k in range(0, len(starts), 64):
            cut = np.append(starts, len(key))[k:k + 65].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(key[cut[:-1]]), pa.array([x[:, a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=POSTINGS)

    def run(it):
        held, n = [], 0
        for x in rows(it):
            held.append(x)
            n += len(x[0])
            if n >= HELD:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    columns = ["doc", "line", "size", "parity", "half", "prefix", "blocks"]
    return map_batches(classes.select(*columns, F.xxhash64("doc", "line").alias("h")), run, POSTINGS)


def prefix_words(classes: DataFrame) -> DataFrame:
    """(h): the kept bits of each prefix word."""
    schema = pa.schema([("h", pa.int64())])

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(b.column("prefix"))[0] >> 24)], schema=schema)

    return map_batches(classes.select("prefix"), run, schema)


def _place(words: np.ndarray) -> np.ndarray:
    """A word's place in a bit table (the lower bits of its hash are cut off)."""
    return (words >> 24) % FLAGS


PAIR = pa.schema([("doc", pa.int64()), ("line", pa.int64()), ("e_doc", pa.int64()), ("e_line", pa.int64()), ("more", pa.bool_())])


def _bounds(x: dict[str, np.ndarray], num: int, den: int) -> dict[str, np.ndarray]:
    """The terms of the filters: two postings pass if the lesser ``left`` reaches the sum of ``need``, and the
    differing parity bits, times num + den, at most the sum of ``room``.

    The first is the positional filter, 1 + min(n - i - 1, m - j - 1) >= t / (1 + t) (n + m), and implies the length filter."""
    top = (num + den) * max(64, int(x["size"].max(initial=0)))
    kind = np.int16 if top < 1 << 13 else np.int32 if top < 1 << 29 else np.int64
    size = x["size"].astype(kind)
    return dict(x, left=kind(num + den) * (size - x["at"].astype(kind)), need=kind(num) * size, room=kind(den - num) * size)


def _passes(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length, positional and parity filters between two sets of postings."""
    ok = np.minimum(x["left"][a], x["left"][b]) >= x["need"][a] + x["need"][b]
    ok &= np.bitwise_count(x["parity"][a] ^ x["parity"][b]) * x["room"].dtype.type(num + den) <= x["room"][a] + x["room"][b]
    return ok


def _agrees(x, a, b, num: int, den: int) -> np.ndarray:
    """The parity filter on both halves of the words apart, twice as many places."""
    half = x["half"][a] ^ x["half"][b]
    rest = x["parity"][a] ^ x["parity"][b] ^ half
    sizes = x["size"][a] + x["size"][b]
    return np.bitwise_count(half) + np.bitwise_count(rest) <= sizes - 2 * -(-(num * sizes) // (num + den))


def _shared(held: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The postings of a bucket that share their word and unit with others, in the order (word, unit, doc, line)."""
    x = np.concatenate(held, 1)
    unit, word, _, _, doc, line, _ = x
    low, last = int(doc.min()), int(line.max()) + 1
    if (int(doc.max()) - low + 1) * last < 1 << 62:
        order = np.argsort((doc - low) * last + line)
    else:
        order = np.lexsort((line, doc))
    if len(order) < 1 << 24 and unit.max() < 4:  # one unit: places fit below a word's kept bits
        order = order[np.argsort(word[order] + np.arange(len(order)))]
    else:
        order = order[np.lexsort((unit[order] >> 2, word[order]))]
    same = word[order[1:]] == word[order[:-1]]
    x = x[:, order[np.append(False, same) | np.append(same, False)]]
    x = dict(zip(POSTING, x))
    shape = x.pop("shape")
    return dict(x, size=shape >> 16, at=shape & 0xFFFF)


def candidates(posts: DataFrame, threshold: Fraction, first: int | None) -> DataFrame:
    """(doc, line, e_doc, e_line, more): for each line, candidates before it that
    pass the filters; at most ``first`` for each shared word; more: there were
    others.  None: all candidates of the marked lines, and of no others."""
    num, den = threshold.numerator, threshold.denominator

    def compare(x, left, right, same: bool):
        """Each row of ``right`` against the earlier rows of ``left`` (index arrays, in order)."""
        for k in range(0, len(right), 512):
            mine = right[k:k + 512]
            got = np.zeros(len(mine), np.int64)
            for m in range(0, len(left), 4096):
                if same and left[m] > mine[-1]:
                    break
                theirs = left[m:m + 4096]
                todo = np.arange(len(mine)) if first is None else np.flatnonzero(got <= first)
                if not len(todo):
                    break
                i, j = np.divmod(np.flatnonzero(_passes(x, mine[todo][:, None], theirs[None, :], num, den)), len(theirs))
                a, b = mine[todo[i]], theirs[j]
                near = (x["doc"][b] < x["doc"][a]) | ((x["doc"][b] == x["doc"][a]) & (x["line"][b] < x["line"][a]))
                near &= _agrees(x, a, b, num, den)
                i, j = i[near], j[near]
                if not len(i):
                    continue
                rank = np.arange(len(i)) - np.searchsorted(i, i) + got[todo][i]
                got[todo] += np.bincount(i, minlength=len(todo))
                keep = rank <= first if first is not None else np.ones(len(i), bool)
                i, j, rank = i[keep], j[keep], rank[keep]
                # the candidate past the limit only says that there are more
                yield mine[todo][i], theirs[j], (rank == first if first is not None else np.zeros(len(i), bool))

    def run(it):
        held, bucket = [], None
        for b in it:
            for key, raw in zip(b.column("bucket").to_pylist(), b.column("packed")):
                if key != bucket and held:
                    yield from groups(_shared(held))
                    held = []
                bucket = key
                held.append(np.frombuffer(raw.as_buffer(), np.int64).reshape(len(POSTING), -1))
        if held:
            yield from groups(_shared(held))

    def groups(x):
        n = len(x["word"])
        if n < 2:
            return
        x = _bounds(dict(x, parity=x["parity"].view(np.uint64), half=x["half"].view(np.uint64)), num, den)
        unit = x["unit"] >> 2
        starts = np.flatnonzero(np.concatenate([[True], (x["word"][1:] != x["word"][:-1]) | (unit[1:] != unit[:-1])]))
        ends = np.append(starts[1:], n)
        wide = ends - starts
        later, earlier, more = [], [], []

        def out():
            a, b = np.concatenate(later), np.concatenate(earlier)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(x["doc"][a]), pa.array(x["line"][a]), pa.array(x["doc"][b]), pa.array(x["line"][b]),
                 pa.array(np.concatenate(more))], schema=PAIR)
            later.clear(), earlier.clear(), more.clear()
            return batch

        inside = (unit[starts] >> 31) == (unit[starts] & 0x7FFFFFFF)
        small = inside & (wide <= SMALL)
        # small groups, all at once: each row against the one ``lag`` places before it
        at = np.flatnonzero(np.repeat(small & (wide > 1), wide))
        group = np.repeat(np.arange(len(starts)), wide)
        got, lag = np.zeros(n, np.int64), 1
        marked = np.ones(n, bool) if first is not None else (x["unit"] & 2).astype(bool)
        at = at[marked[at]]
        while len(at := at[(at >= lag)][group[at[at >= lag]] == group[at[at >= lag] - lag]]):
            ok = _passes(x, at, at - lag, num, den)
            ok &= (x["doc"][at] != x["doc"][at - lag]) | (x["line"][at] != x["line"][at - lag])
            hit = at[ok]
            hit = hit[_agrees(x, hit, hit - lag, num, den)]
            if first is not None:
                hit = hit[got[hit] <= first]
            if len(hit):
                later.append(hit)
                earlier.append(hit - lag)
                more.append(got[hit] == first if first is not None else np.zeros(len(hit), bool))
                got[hit] += 1
            lag += 1
        if sum(map(len, later)) >= 1 << 16:
            yield out()
        for k in np.flatnonzero((~small & (wide > 1)) | ~inside).tolist():
            rows = np.arange(starts[k], ends[k])
            u = int(unit[starts[k]])
            if u >> 31 == u & 0x7FFFFFFF:
                work = [(rows, rows[marked[rows]], True)]
            else:
                side = (x["unit"][rows] & 1).astype(bool)
                work = [(a, b[marked[b]], False) for a, b in ((rows[~side], rows[side]), (rows[side], rows[~side]))]
            for left, right, same in work:
                for a, b, m in compare(x, left, right, same):
                    later.append(a)
                    earlier.append(b)
                    more.append(m)
                    if sum(map(len, later)) >= 1 << 16:
                        yield out()
        if later:
            yield out()

    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(posts.repartition(n, "bucket").sortWithinPartitions("bucket"), run, PAIR)


def _flags(keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size over a column h of hashes: no false negatives."""
    schema = pa.schema([("chunk", pa.int64()), ("counts", pa.binary())])

    def run(it):
        seen = np.zeros(FLAGS, np.uint8)
        for b in it:
            seen[b.column("h").to_numpy()] = 1
        yield from batches(schema, _chunks(seen))

    rows = map_batches(keys.select(F.pmod("h", F.lit(FLAGS)).alias("h")), run, schema)
    return np.packbits(_add_up(rows, FLAGS, "u1") > 0)


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's xxhash64 of longs; over several columns, the hash of one seeds that of the next."""
    def turned(v, n):
        return v << np.uint64(n) | v >> np.uint64(64 - n)

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = turned((seed + (p5 + np.uint64(8))) ^ turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)


def _split(column: pa.Array) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray]]:
    """Each line of a text column with the ``\\n`` at its end, if it has one; its row and its number in the row."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i8")[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ends = np.flatnonzero(raw[at[0]:at[-1]] == 10) + at[0]
    count = np.diff(np.searchsorted(ends, at)) + 1
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(column)), count)
    starts = np.empty(len(row) + 1, np.int64)
    inner = np.ones(len(row) + 1, bool)
    inner[first], inner[-1] = False, False
    starts[first], starts[inner], starts[-1] = at[:-1], ends + 1, at[-1]
    lines_ = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(starts), data or pa.py_buffer(b"")])
    return lines_, (row, np.arange(len(row)) - first[row])


def verify(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """Distinct (doc, line) of pairs whose word sets reach the threshold."""
    ends = pairs.select("doc", "line").union(pairs.select("e_doc", "e_line")).distinct()
    wanted = store(ends, "line-ends")
    flags = docs.sparkSession.sparkContext.broadcast(
        _flags(wanted.select(F.xxhash64("doc", "line").alias("h"))))  # 512 KB, fixed
    schema = pa.schema([("doc", pa.int64()), ("line", pa.int64()), ("text", pa.binary())])

    def texts(it):
        bits = np.unpackbits(flags.value).astype(bool)
        for b in it:
            text, (row, no) = _split(b.column(1))
            doc = b.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()[row]
            no = no + (b.column(2).to_numpy() << LINE_BITS)[row]
            found = np.flatnonzero(bits[(_hash_long(no, _hash_long(doc, np.uint64(42))) % np.uint64(FLAGS)).astype(np.int64)])
            for k in range(0, len(found), 4096):
                some = found[k:k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[some]), pa.array(no[some]), pc.ascii_lower(text.take(pa.array(some))).cast(pa.binary())], schema=schema)

    some = map_batches(docs.select(id_col, text_col, "__row"), texts, schema)
    some = store(some.join(wanted, ["doc", "line"], "left_semi"), "line-texts")
    both = pairs.select("doc", "line", "e_doc", "e_line").join(some, ["doc", "line"]).join(
        some.select(F.col("doc").alias("e_doc"), F.col("line").alias("e_line"), F.col("text").alias("e_text")), ["e_doc", "e_line"])
    num, den = threshold.numerator, threshold.denominator
    key = pa.schema([("doc", pa.int64()), ("line", pa.int64())])

    def check(rows):
        for doc, line, a, b in rows:
            x, y = set(a.split()), set(b.split())
            common = len(x & y)
            if common and den * common >= num * (len(x) + len(y) - common):
                yield doc, line

    return map_rows(both.select("doc", "line", "text", "e_text"), check, key).distinct()


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows with ``__row``: 0 for the only row of an id, else a number of the row's own."""
    single, many = own_rows(docs, id_col, text_col)
    single = single.withColumn("__row", F.lit(0).cast("long"))
    return single if many is None else single.unionByName(many)


def later_matches(docs: DataFrame, id_col: str, text_col: str, threshold: str = "0.8") -> tuple[DataFrame, DataFrame]:
    """(all lines with words (doc, line), the removed ones (doc, line)) of ``numbered`` rows."""
    t = Fraction(threshold)
    every = store(lines(docs, id_col, text_col, rarity(docs, text_col), t), "lines")
    # the first line of each class carries on; equal lines are merged before the shuffle
    classes = store(every.groupBy("hi", "lo").agg(F.min(F.struct("doc", "line", "size", "parity", "half", "prefix", "blocks")).alias("f"), F.count("*").alias("n"))
                    .select("hi", "lo", "f.*", "n"), "line-classes")
    posts = postings(classes)
    pairs = store(candidates(posts, t, FIRST).groupBy("doc", "line", "e_doc", "e_line").agg(
        F.min("more").alias("beyond"), F.max("more").alias("more")), "line-pairs")
    dup = store(verify(docs, id_col, text_col, pairs.where("not beyond"), t), "line-dups")
    open_ = store(pairs.where("more").select("doc", "line").distinct().join(dup, ["doc", "line"], "left_anti"), "line-open")
    if open_.limit(1).count():
        # the open lines against everything that shares a prefix word with one of them
        words = prefix_words(classes.join(open_, ["doc", "line"], "left_semi"))
        again = postings(classes, _flags(words), _flags(open_.select(F.xxhash64("doc", "line").alias("h"))))
        all_pairs = candidates(again, t, None).join(open_, ["doc", "line"], "left_semi").select(
            "doc", "line", "e_doc", "e_line").distinct()
        dup = dup.union(verify(docs, id_col, text_col, store(all_pairs, "line-pairs"), t))
    fate = classes.join(dup.withColumn("dup", F.lit(True)), ["doc", "line"], "left").select(
        "hi", "lo", F.col("doc").alias("f_doc"), F.col("line").alias("f_line"), "dup", "n").where("dup or n > 1")
    removed = every.select("doc", "line", "hi", "lo").join(fate, ["hi", "lo"]).where(
        "dup or doc <> f_doc or line <> f_line").select("doc", "line")
    return every.select("doc", "line"), removed  # a line is one row of ``every``, and its class one of ``fate``


def _row() -> Column:
    return F.shiftright("line", LINE_BITS).alias("__row")


def _number() -> Column:
    return F.col("line").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")


def report(docs: DataFrame, id_col: str, text_col: str, threshold: str = "0.8") -> DataFrame:
    """(id, n_lines, n_removed, removed_lines) for every row's id; lines counted have words."""
    docs = numbered(docs, id_col, text_col)
    every, removed = later_matches(docs, id_col, text_col, threshold)
    total = every.groupBy("doc", _row()).agg(F.count("*").alias("n_lines"))
    gone = removed.groupBy("doc", _row()).agg(F.array_sort(F.collect_list(_number())).alias("removed_lines"))
    key = F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc")
    both = ["doc", "__row"]
    return docs.select(F.col(id_col).alias("id"), key, "__row").join(total, both, "left").join(gone, both, "left").select(
        "id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def apply(docs: DataFrame, id_col: str, text_col: str, threshold: str = "0.8") -> DataFrame:
    """The documents without their later matches, all columns kept; a document
    that loses every line it had words in is dropped."""
    at, out = docs.columns.index(text_col), docs.schema
    docs = numbered(docs, id_col, text_col)
    _, removed = later_matches(docs, id_col, text_col, threshold)
    gone = removed.groupBy(F.col("doc").alias("__doc"), _row()).agg(F.collect_list(_number()).alias("__gone"))
    table = docs.withColumn("__doc", F.coalesce(F.col(id_col), F.lit(NO_ID))).join(
        gone, ["__doc", "__row"], "left").drop("__doc", "__row")

    def run(it):
        for b in it:
            texts = b.column(at).to_pylist()
            cuts = b.column(b.num_columns - 1).to_pylist()
            keep, new = [], []
            for text, cut in zip(texts, cuts):
                if cut and text:
                    drop = set(cut)
                    rest = [x for k, x in enumerate(text.split("\n")) if k not in drop]
                    text = "\n".join(rest)
                    keep.append(bool(text.encode().split()))
                else:
                    keep.append(True)
                new.append(text)
            cols = [*b.columns[:-1]]
            cols[at] = pa.array(new, type=b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return map_batches(table, run, out)
