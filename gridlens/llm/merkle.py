"""A Merkle manifest of a dataset, with a witness for every row.

The rows of a source, in order, are the leaves of its tree; runs of ``ARITY`` nodes have one
parent, the last run of a level may be shorter, and the tree ends when one node remains.  The
roots of the sources, in order, are the leaves of the top tree.

Witnesses grow while nodes are appended (``Frontier``).  Every open subtree holds the rows
below it; when a run closes, each of its subtrees passes the siblings of that level
on to the witnesses of its rows, and they go on together, as one open subtree of the next level.

A source of any size is spread over tasks.  ``positions`` numbers its rows without gathering
them; ``BLOCK`` = ARITY^HEIGHT aligned rows are appended in one task, which gives the
block's root and the witnesses of its rows up to it.  The roots of the blocks are further appends: a
next round treats them as rows, in blocks of their own, until each source has one root.
Then the rows read the witness of their block root by (source, block), at most
``BLOCK`` rows a key.

A witness is packed: for each level one byte with the place in the run, one byte with the
run's length, and the siblings' digests of 32 bytes, left to right.

Defined cases: null is hashed as ``-``, which no value is.  Null sources come first, then
the sources by their UTF-8 bytes; null ids come first; rows of one id go by their digests, and equal rows
are leaves of their own.  A source of one row has that leaf as its root.  An empty table gives no rows.
Other columns than the given ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, map_batches, store

ARITY = 3
HEIGHT = 7
BLOCK = ARITY ** HEIGHT

#: Rows (about 200 bytes each) that a task is given.
_TASK_ROWS = 400_000


def leaf(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns, each ``-`` if null, else bytes, ``:``, value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
                             for c in text]), 256)


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Frontier:
    """Appends leaves to a tree and extends the witnesses of all open subtrees."""

    def __init__(self, height: int, arity: int = ARITY):
        self.arity, self.height = arity, height
        self.open: list[list[tuple[bytes, list[int]]]] = [[] for _ in range(height + 1)]
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        self.witness.append(bytearray())
        self._push(0, digest, [len(self.witness) - 1])

    def _push(self, level: int, digest: bytes, rows: list[int]) -> None:
        self.open[level].append((digest, rows))
        if len(self.open[level]) == self.arity and level < self.height:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for i, (_, rows) in enumerate(run):
            step = bytes((i, len(run))) + b"".join(digests[:i] + digests[i + 1:])
            for r in rows:
                self.witness[r] += step
        self._push(level + 1, parent(digests), [r for _, rows in run for r in rows])

    def finish(self, alone: bool) -> bytes:
        """The root.  A tree that is ``alone`` ends at its last node; a block of a larger tree
        goes up to its full height."""
        for level in range(self.height):
            if alone and len(self.open[level]) == 1 and not any(self.open[level + 1:]):
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
        return self.open[self.height][0][0]


_ROUND = pa.schema([("key", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("root", pa.binary()), ("pos", pa.int64()),
                    ("name", pa.string()), ("id", pa.int64()), ("digest", pa.binary()), ("other", pa.binary()), ("witness", pa.binary())])


def _append(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, block, n, pos, name, id, digest, other), in order, to rows with
    witnesses and one row with each block's root."""
    def rows() -> Iterator[tuple]:
        for b in it:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def out() -> Iterator[tuple]:
        at, tree, mine, n = None, None, [], 0

        def done() -> Iterator[tuple]:
            blocks = -(-n // BLOCK)
            root = tree.finish(blocks == 1)
            yield (*at, blocks, root, None, None, None, None, None, None)
            for (pos, *rest), witness in zip(mine, tree.witness):
                yield (*at, blocks, None, pos, *rest, bytes(witness))

        for key, block, n_of, *rest in rows():
            if (key, block) != at:
                if at:
                    yield from done()
                at, tree, mine, n = (key, block), Frontier(HEIGHT), [], n_of
            mine.append(rest)
            tree.append(rest[3])
        if at:
            yield from done()

    yield from batches(_ROUND, out())


def _tasks(df: DataFrame, rows: int) -> int:
    return max(1, -(-rows // _TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, rows // 1000))


def positions(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` with pos (from 0) in the order of its key's rows, and n, the key's rows.

    ``rows`` is a stored table.  It is dealt by ranges of (key, order, a number of the row), which
    no two rows share, and written in that order; a key's rows of a range are consecutive, so
    their places follow from the ranges' counts."""
    n = _tasks(rows, rows.count())
    rows = rows.withColumn("__own", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, "key", *order, "__own").sortWithinPartitions("key", *order, "__own").drop("__own")
    rows = store(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), tag)
    runs = rows.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                       F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    return rows.join(runs, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def forest(rows: DataFrame, tag: str, crown) -> DataFrame:
    """Trees over (key, pos, n, name, id, digest, other); ``crown`` gets (key, root) of every
    tree and returns (key, up, ...): the witness above the root, and what else its rows need."""
    levels, total = [], rows.count()
    while True:
        dealt = rows.select("key", F.floor(F.col("pos") / BLOCK).alias("block"), "n", "pos", "name", "id", "digest", "other")
        dealt = dealt.repartition(_tasks(rows, total), "key", "block").sortWithinPartitions("key", "block", "pos")
        out = store(map_batches(dealt, _append, _ROUND), f"{tag}-round")
        roots = out.where("root is not null").select("key", "block", "blocks", "root")
        levels.append(out.where("root is null").drop("root"))
        last = roots.agg(F.count("*").alias("n"), F.coalesce(F.max("blocks"), F.lit(0)).alias("most")).first()
        if last["most"] <= 1:
            break
        none = {"name": F.lit(None).cast("string"), "id": F.lit(None).cast("long"), "other": F.lit(None).cast("binary")}
        rows, total = roots.select("key", F.col("block").alias("pos"), F.col("blocks").alias("n"), F.col("root").alias("digest"))\
            .withColumns(none), last["n"]
    above = crown(roots.select("key", "root"))
    found = levels.pop().join(above, "key")  # at most BLOCK rows a key
    extra = [c for c in above.columns if c not in ("key", "up")]
    whole = F.concat("witness", "up").alias("witness")
    while levels:
        above = found.select("key", F.col("pos").alias("block"), whole.alias("up"), *extra)
        found = levels.pop().join(above, ["key", "block"])
    return found.select("key", "name", "id", "digest", "other", whole, *extra)


def manifest(docs: DataFrame, id_col: str, source_col: str, fields: list[str], other: Column | None = None) -> DataFrame:
    """id, leaf, subroot, root, witness (binary digests) of every row; ``other``, a
    column of leaves (hex) to be verified in the rows' places, comes out as given, in binary."""
    other = F.lit(None).cast("string") if other is None else other
    name = F.col(source_col).cast("string")
    rows = docs.select(F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)).alias("key"),
                       F.lit(None).cast("string").alias("name"), F.col(id_col).cast("long").alias("id"),
                       F.unhex(leaf([F.col(f) for f in fields])).alias("digest"), F.unhex(other).alias("other"))
    rows = positions(store(rows, "merkle-leaves"), ["id", "digest"], "merkle-order")

    def top(roots: DataFrame) -> DataFrame:
        trees = store(roots.select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("id"),
                                   F.lit(None).cast("binary").alias("other")), "merkle-roots")
        trees = positions(trees, ["name"], "merkle-root-order")
        end = forest(trees, "merkle-top", lambda r: r.withColumn("up", F.lit(b"")))
        return end.select(F.col("name").alias("key"), F.col("witness").alias("up"), F.col("digest").alias("subroot"), "root")

    return forest(rows, "merkle", top).select("id", F.col("digest").alias("leaf"), "other", "subroot", "root", "witness")


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings) of each level."""
    at = 0
    while at < len(witness):
        place, end = witness[at], at + 2 + 32 * (witness[at + 1] - 1)
        yield place, [witness[k:k + 32] for k in range(at + 2, end, 32)]
        at = end


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, siblings in steps(witness):
        digest = parent(siblings[:place] + [digest] + siblings[place:])
    return digest


_PROOF = pa.schema([("id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary()), ("proof_sha256", pa.string()),
                    ("folded_root", pa.binary()), ("verified", pa.bool_())])


def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[tuple]:
        for b in it:
            for id_, digest, other, subroot, root, witness in zip(*(c.to_pylist() for c in b.columns)):
                siblings = "".join(d.hex() for _, found in steps(witness) for d in found)
                folded = fold(digest if other is None else other, witness)
                yield id_, digest, subroot, root, hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == root

    yield from batches(_PROOF, out())


def verify(rows: DataFrame) -> DataFrame:
    """Folds ``other``, else the leaf, of each row of a ``manifest`` up to the root."""
    return map_batches(rows.select("id", "leaf", "other", "subroot", "root", "witness"), _verify, _PROOF)
