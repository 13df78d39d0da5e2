"""Filter interaction audit by forward-backward path counting.

k filters applied one after the other walk through the lattice of the 2^k subsets of
filters: an order of the filters is a path from the empty to the full set, and a step
is an edge (set applied so far, next filter).  What a step removes depends on its edge
alone, so an edge is measured once for all orders that use it:

* every document becomes a bit mask of the filters it fails; the documents are summed
  to one row per part and mask, at most 2^k rows per part;
* ``forward[S]`` counts the orders that reach S, ``backward[S]`` those that leave it for
  the full set; ``forward[S] * backward[S + f]`` orders use the edge (S, f);
* a filter's Shapley sum is its edges' removals, each weighted by that product;
* the steps of each order are read from the same edges by an equi-join.

The lattice has k * 2^(k-1) edges and the orders k! * k steps, whatever the data: both
are broadcast.  k is at most ``MOST_FILTERS``; parts and documents are unbounded.

Defined cases: a null text is the empty text, a null part the empty string.  A row with
a null id has no earlier row and is none.  Rows with one id and one text are no copies of
each other.  Labels of one id are united (1 if any row says 1); a null id has none.  An empty table gives no rows;
texts of any length count whole.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Orders are listed in full: 7! * 7 = 35,280 steps at most.
MOST_FILTERS = 7

#: A filter that fails a document whose text an earlier id has.
EARLIER_COPY = "earlier copy"

_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def few_words(least: int) -> Callable[[Column], Column]:
    return lambda text: F.size(words(text)) < least


def repetitive(percent: int) -> Callable[[Column], Column]:
    """Distinct words are under ``percent`` of the words."""
    return lambda text: 100 * F.size(F.array_distinct(words(text))) < percent * F.size(words(text))


def many_of(characters: str, percent: int) -> Callable[[Column], Column]:
    """Characters of the regex class are over ``percent`` of the code points."""
    return lambda text: 100 * F.length(F.regexp_replace(text, f"[^{characters}]+", "")) > percent * F.length(text)


def holds_any(characters: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(f"[{characters}]")


def lattice(k: int) -> list[tuple[int, int, int]]:
    """(state, bit, orders through) of each edge; the numbers of states are a topological order."""
    full = (1 << k) - 1
    forward, backward = [1] + [0] * full, [0] * full + [1]
    for s in range(full + 1):
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in range(full, -1, -1):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return [(s, 1 << f, forward[s] * backward[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def masks(docs: DataFrame, id_col: str, text_col: str, part_col: str, filters: dict) -> DataFrame:
    """(id, part, mask) of each document: bit i is set where it fails the i-th filter."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    text = F.col("text")
    own = [F.when(rule(text), 1 << i).otherwise(0) for i, rule in enumerate(filters.values()) if rule != EARLIER_COPY]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "part", sum(own, F.lit(0)).alias("mask"), F.unhex(F.sha2("text", 256)).alias("hash"))
    late = [1 << i for i, rule in enumerate(filters.values()) if rule == EARLIER_COPY]
    if not late:
        return rows.drop("hash")
    rows = store(rows, "audit-rows")  # narrow; the texts are read once
    # one row per repeated text, combined before the shuffle
    first = store(rows.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "audit-copies")
    # texts with over a thousandth of all rows, at most 1,000, are broadcast; their rows
    # take no part in the join on the others
    common = F.col("n") > rows.count() / 1000
    rows = rows.join(F.broadcast(first.where(common).withColumnRenamed("n", "copies")), "hash", "left")
    rows = rows.where("copies is not null").drop("copies").unionByName(
        rows.where("copies is null").drop("first", "copies").join(first.where(~common).drop("n"), "hash", "left"))
    return rows.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), sum(late)).otherwise(0)).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, label_id: str, good: Column, toxic: Column) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those of them with each label."""
    marks = labels.select(F.col(label_id).alias("id"), F.coalesce(good, F.lit(False)).cast("int").alias("good"),
                          F.coalesce(toxic, F.lit(False)).cast("int").alias("toxic")).where("id is not null")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.where("id is not null").join(marks, "id", "left").unionByName(rows.where("id is null"), allowMissingColumns=True)
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def edges(counts: DataFrame, k: int) -> DataFrame:
    """(part, state, bit, kept, removed, ..., shapley): each edge of the lattice, measured in each part."""
    table = counts.sparkSession.createDataFrame(lattice(k), "state int, bit int, paths long")
    at = counts.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))).join(F.broadcast(table), "state")
    mask, state, bit = F.col("mask"), F.col("state"), F.col("bit")
    fails, alive = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(state) == 0

    def over(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    out = at.groupBy("part", "state", "bit", "paths").agg(
        over(alive & ~fails, "n").alias("kept"), over(alive & fails, "n").alias("removed"),
        over(~alive & fails, "n").alias("redundant"), over(mask == bit, "n").alias("unique_fails"),
        over(alive & fails, "good").alias("good_lost"), over(alive & fails, "toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum(F.col("paths") * F.col("removed")).over(Window.partitionBy("part", "bit")))


def audit(docs: DataFrame, id_col: str, text_col: str, part_col: str, filters: dict, labels: DataFrame,
          label_id: str, good: Column, toxic: Column) -> DataFrame:
    """One row per part, order of all filters and step.

    ``filters`` maps a name to a function of the text column that is true where a
    document fails, or to ``EARLIER_COPY``.  ``good`` and ``toxic`` are conditions on
    ``labels``.  Columns: part, filter_order (the names, joined), step, kept (documents left
    after it), removed (in it), redundant (failing its filter, gone before), unique_fails (failing
    its filter alone), good_lost, toxic_lost, shapley (removals by its filter over all orders).
    """
    names = list(filters)
    counts = cells(masks(docs, id_col, text_col, part_col, filters), labels, label_id, good, toxic)
    steps = [("".join(names[i] for i in order), at + 1, sum(1 << i for i in order[:at]), 1 << f)
             for order in permutations(range(len(names))) for at, f in enumerate(order)]
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, bit int")
    return edges(counts, len(names)).join(F.broadcast(steps), ["state", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
