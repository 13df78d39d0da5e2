"""Exact ordered prefix sums / positions without a single-task window.

``Window.orderBy(...)`` with no (or a low-cardinality) partition key sends a
whole class to one task.  Instead:

1. range-partition by (group, order) keys -> sorted runs across partitions;
2. checkpoint that layout to the shared checkpoint folder, so both uses
   below see the same partition assignment (range boundaries come from
   sampling; a recomputation could move rows), and lineage is cut;
3. per (partition, group): running sums inside the partition (bounded by a
   partition's size) and totals (one row per partition and group);
4. exclusive prefix over partition totals (n_partitions rows per group),
   joined back by broadcast: its size is n_partitions x n_groups, bounded
   because callers pass low-cardinality groups (labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import ensure_checkpoint_dir


def prefix_sums(df: DataFrame, order_cols: list, value_cols: list[str],
                group_cols: list[str] | None = None, num_partitions: int | None = None,
                prefix: str = "cum_") -> DataFrame:
    """Add ``prefix + v`` = inclusive running sum of ``v`` within ``group_cols``
    in ``order_cols`` order (order keys must make rows unique)."""
    group_cols = group_cols or []
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group_cols, *order_cols) \
        .sortWithinPartitions(*group_cols, *order_cols) \
        .withColumn("__pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    w_local = Window.partitionBy("__pid", *group_cols).orderBy(*order_cols) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({f"__l_{v}": F.sum(v).over(w_local) for v in value_cols})
    totals = ranged.groupBy("__pid", *group_cols).agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    w_off = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))) \
        .orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *group_cols, *[
        F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}") for v in value_cols])
    out = local.join(F.broadcast(offsets), ["__pid", *group_cols], "left")
    out = out.withColumns({prefix + v: F.col(f"__l_{v}") + F.col(f"__o_{v}") for v in value_cols})
    return out.drop("__pid", *[f"__l_{v}" for v in value_cols], *[f"__o_{v}" for v in value_cols])


def positions(df: DataFrame, order_cols: list, group_cols: list[str] | None = None,
              name: str = "position") -> DataFrame:
    """1-based position of each row within its group in ``order_cols`` order."""
    out = prefix_sums(df.withColumn("__one", F.lit(1).cast("bigint")), order_cols, ["__one"],
                      group_cols, prefix="__cum")
    return out.withColumnRenamed("__cum__one", name).drop("__one")
