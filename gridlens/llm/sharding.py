"""Sharding by vector bin packing over bytes, tokens and rows.

Rows with equal texts form a group.  Each group goes to the shard where the dot
product of its size vector (bytes, tokens, rows, each as a share of the whole)
with the shard's residual capacity is highest.

Groups are as many as the data, so they are not placed one by one on the
driver.  A group larger than ``1 / heavy`` of the whole in any measure is an
item by itself (there are at most 3 x ``heavy`` such groups); all others
are hashed into ``bins`` bins, and a bin is an item.  The list of items is bounded by
these two parameters whatever the input.  A group larger than ``1 / shards`` of
the whole in any measure can't fit a shard: its rows, which have one size, are dealt by
turns into as few pieces as fit, whatever their ids.

Slots number a shard's rows from 0 in (id, size, checksum) order through a range partition
and per-partition counts, not a one-task window.

Null texts have size 1 and count as empty; rows that tie in every key are equal in
all output columns but the slot.  Empty input gives no rows.  Columns other than
the two named are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store


def pack(items: list[tuple], shards: int) -> list[int]:
    """Place items ((bytes, tokens, rows) vectors), largest first; returns their shards."""
    if not items:
        return []
    v = np.array(items, float)
    total = v.sum(0)
    v = v / np.where(total > 0, total, 1)
    residual = np.full((shards, 3), 1.0 / shards)
    out = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-v[i].max(), i)):
        k = int(np.argmax(residual @ v[i]))
        residual[k] -= v[i]
        out[i] = k
    return out


def _tokens(text: Column) -> Column:
    """White-space separated tokens, counted as separators plus one."""
    return F.length(text) - F.length(F.translate(text, " \t\n", "")) + 1


def assign(df: DataFrame, id_col: str, text_col: str, shards: int = 16, bins: int = 8192, heavy: int = 8192) -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), _tokens(text).cast("long").alias("tokens"),
        F.xxhash64(text).alias("g"))  # a collision only keeps two groups together
    # the table that both passes below read: small columns, no texts
    rows = store(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "shard-rows")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")]
    groups = rows.groupBy("g").agg(*sums)
    total = rows.agg(*sums).first()
    if not total["n"]:
        return rows.select("id", "size", F.col("crc").alias("text_crc32"), "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = [max(1, total[c]) for c in "btn"]
    big = groups.where(" or ".join(f"{c} * {float(heavy)} > {w}" for c, w in zip("btn", whole)))
    big = {r["g"]: (r["b"], r["t"], r["n"]) for r in big.collect()}  # at most 3 x heavy
    pieces = {g: max(1, math.ceil(max(x / w for x, w in zip(v, whole)) * shards)) for g, v in big.items()}
    spark = df.sparkSession
    table = spark.createDataFrame([(g, pieces[g]) for g in big], "g long, pieces int")
    known = rows.join(F.broadcast(table), "g", "left")
    whole_groups = known.where("pieces is null or pieces = 1").select(
        "id", "size", "crc", "tokens",
        F.when(F.col("pieces").isNull(), F.pmod("g", F.lit(bins))).otherwise(F.col("g")).alias("item"),
        F.col("pieces").isNotNull().alias("alone"), F.lit(0).alias("piece"))
    # the place of a row within its group: its place among those of its part, after the earlier parts
    split = known.where("pieces > 1")
    counts = split.groupBy("g", "part").agg(F.count("*").alias("n"))
    before = counts.select("g", "part", (F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy("at")) - 1 + F.col("before")
    dealt_groups = split.join(before, ["g", "part"]).select(
        "id", "size", "crc", "tokens", F.col("g").alias("item"), F.lit(True).alias("alone"),
        F.pmod(place, F.col("pieces")).cast("int").alias("piece"))
    keyed = whole_groups.unionAll(dealt_groups)
    items = keyed.groupBy("item", "alone", "piece").agg(*sums).collect()  # at most bins + pieces
    items.sort(key=lambda r: (r["alone"], r["item"], r["piece"]))
    where = pack([(r["b"], r["t"], r["n"]) for r in items], shards)
    plan = spark.createDataFrame([(r["item"], r["alone"], r["piece"], k) for r, k in zip(items, where)],
                                 "item long, alone boolean, piece int, shard int")
    dealt = keyed.join(F.broadcast(plan), ["item", "alone", "piece"])
    return _slots(dealt).select("id", "size", F.col("crc").alias("text_crc32"), "tokens", "shard", "slot")


def _slots(dealt: DataFrame) -> DataFrame:
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "id", "size", "crc"]
    ranged = store(dealt.repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .withColumn("part", F.spark_partition_id()), "shard-slots")
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))  # partitions x shards at most
    before = counts.select("shard", "part", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("part", "shard").orderBy("id", "size", "crc")) - 1
    return ranged.withColumn("local", local).join(F.broadcast(before), ["shard", "part"]).withColumn(
        "slot", (F.col("local") + F.col("before")).cast("long"))
