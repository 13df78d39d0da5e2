"""Exact dedup by Grace hashing: partition, spill what does not fit, recurse.

1. ``condense``: every task runs its rows through an open-addressing table that
   compares complete contents, and flushes it at ``FLUSH`` bytes.  A text goes on as one
   *record* (text, copies, best row) per flush, however many copies the task has met: a text
   with a third of all rows becomes a few records per task.  Rows and records are
   written once to the shared folder.
2. Records are dealt to buckets by a hash of the content, as many as the stored bytes
   ask for.  ``absorb`` streams a bucket through a table of at most ``LIMIT`` bytes.  A
   content that finds the table full is spilled; all its copies are, as a full
   table never shrinks.  Groups that were absorbed come out with size and winner.
3. Each level is written to the shared folder: its answers, and its spill, which the next level deals
   anew by another hash.  A bucket absorbs at least one content a level, so the levels
   end; a group of equal texts is never cut.
4. The rows read their group's answer by the number of their record.

A record is about one content of one task, so no step holds a group: ``absorb`` keeps 24
bytes per record besides its table.  Lost executors cost at most the running level.

Defined cases: a null text is the empty text.  Of equal texts the row with the largest id
stays; null ids are smallest; of rows that share that id too, exactly one stays.  Texts
longer than ``LIMIT`` are absorbed alone.  An empty table gives no rows.  Other columns are not
touched, whatever their names: they travel in the struct ``row`` if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, map_batches, store

#: Bytes of content a task keeps before it flushes its records.
FLUSH = 16 << 20
#: Bytes of content in a bucket's table.
LIMIT = 48 << 20
#: What a content counts for besides its own bytes.
COST = 256

_RECORD = [("rep", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("size", pa.int64()), ("n", pa.int64()),
           ("best_id", pa.int64()), ("best_at", pa.int64())]
_RECORDS = pa.schema(_RECORD)


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self):
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> int:
        """The number of an equal content, or -1 - the free slot where it belongs."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return k
            at = at + 1 & mask
        return -1 - at

    def add(self, free: int, h: int, text: bytes) -> int:
        """Put a content where ``find`` said; its number."""
        k = len(self.texts)
        self.slots[-1 - free] = k
        self.hashes.append(h)
        self.texts.append(text)
        self.bytes += len(text) + COST
        if 2 * k >= len(self.slots):
            self._grow()
        return k

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = at + 1 & mask
            self.slots[at] = k


def _rank(id_: int | None, at: int) -> tuple:
    return (id_ is not None, id_ or 0, at)


class _Groups:
    """A content table with size and best row of each content."""

    def __init__(self):
        self.table, self.n, self.best = ContentTable(), [], []

    def put(self, k: int, n: int, rank: tuple) -> None:
        if k == len(self.n):
            self.n.append(n)
            self.best.append(rank)
        else:
            self.n[k] += n
            self.best[k] = max(self.best[k], rank)


def _condense(flush: int, fields: list[str]):
    """Rows of a batch at once, records at each flush; the other kind's columns are null."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        groups, reps, shas, carried = _Groups(), [], [], []

        def records() -> Iterator[pa.RecordBatch]:
            t = groups.table
            out = ((rep, h, text, len(text) + COST, n, b[1] if b[0] else None, b[2]) for rep, h, text, n, b in
                   zip(reps, t.hashes, t.texts, groups.n, groups.best))
            for b in batches(_RECORDS, out):
                none = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns, *none, *(pa.nulls(b.num_rows, t) for t in carried)], names=fields)

        for batch in it:
            mine, sha = [], []
            first, carried = at, [c.type for c in batch.columns[3:]]
            for id_, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                k = groups.table.find(h, text)
                if k < 0:
                    if groups.table.bytes and groups.table.bytes + len(text) + COST > flush:
                        yield from records()
                        groups, reps, shas = _Groups(), [], []
                        k = groups.table.find(h, text)
                    k = groups.table.add(k, h, text)
                    reps.append(at)
                    shas.append(hashlib.sha256(text).digest())
                groups.put(k, 1, _rank(id_, at))
                mine.append(reps[k])
                sha.append(shas[k])
                at += 1
            n = batch.num_rows
            none = [pa.nulls(n, t) for _, t in _RECORD[1:]]
            rows = [pa.array(range(first, at), pa.int64()), batch.column(0), pa.array(sha, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), *none, *rows, *batch.columns[3:]], names=fields)
        yield from records()
    return run


_ANSWER = pa.schema([*_RECORD, ("keep_id", pa.int64()), ("keep_at", pa.int64()), ("group_size", pa.int64())])


def _absorb(limit: int):
    """Answers (rep, keep_id, keep_at, group_size), and the spilled records as they came."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, reps, which = _Groups(), [], []

        def spilled() -> Iterable[tuple]:
            for batch in it:
                texts = batch.column(2)
                rest = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
                for i, (rep, h, size, n, best_id, best_at) in enumerate(zip(*rest)):
                    text = texts[i].as_py()
                    k = groups.table.find(h, text)
                    if k < 0:
                        if groups.table.texts and groups.table.bytes + len(text) + COST > limit:
                            yield rep, h, text, size, n, best_id, best_at, None, None, None
                            continue
                        k = groups.table.add(k, h, text)
                    groups.put(k, n, _rank(best_id, best_at))
                    reps.append(rep)
                    which.append(k)

        yield from batches(_ANSWER, spilled())
        best = groups.best
        yield from batches(_ANSWER, ((rep, None, None, None, None, None, None, best[k][1] if best[k][0] else None, best[k][2], groups.n[k])
                                     for rep, k in zip(reps, which)))
    return run


def group(docs: DataFrame, id_col: str, text_col: str, carry: Iterable[str] = (), flush: int = FLUSH,
          limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, sha256 (binary), and
    the columns ``carry`` of its input in the struct ``row``."""
    spark, carry = docs.sparkSession, list(carry)
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"),
                        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    fields = [T.StructField(n, {"text": T.BinaryType(), "sha": T.BinaryType()}.get(n, T.LongType()))
              for n in [n for n, _ in _RECORD] + ["at", "id", "sha"]]
    if carry:
        fields.append(given.schema["row"])
    out = store(map_batches(given, _condense(flush, [f.name for f in fields]),
                            T.StructType([T.StructField(f.name, f.dataType) for f in fields])), "grace-rows")
    left = out.where("text is not null").select(*[n for n, _ in _RECORD])
    found, level = None, 0
    while True:
        total = left.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("rep").alias("n")).first()
        if not total["n"]:
            break
        n = max(spark.sparkContext.defaultParallelism, -(-total["bytes"] * 3 // (2 * limit)))
        done = store(map_batches(left.repartition(n, F.xxhash64("h", F.lit(level))), _absorb(limit), _ANSWER), "grace-level")
        answers = done.where("text is null").select("rep", "keep_id", "keep_at", "group_size")
        found = answers if found is None else found.unionAll(answers)
        left = done.where("text is not null").select(*[n for n, _ in _RECORD])
        level += 1
    rows = out.where("at is not null")
    if found is None:
        found = spark.createDataFrame([], "rep long, keep_id long, keep_at long, group_size long")
    return rows.select("rep", "at", "id", "sha", *(["row"] if carry else [])).join(found, "rep").select(
        "id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.col("sha").alias("sha256"),
        *(["row"] if carry else []))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return group(docs, id_col, text_col, carry=docs.columns).where("kept").select("row.*")
