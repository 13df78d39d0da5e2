"""Exact quantiles of many columns by distributed selection.

1. One aggregate gives each column's count and, from a sketch of bounded size, a bracket of
   values around each quantile.
2. A second one counts the values below and up to each bracket.  A bracket that misses its
   ranks (the sketch promises them only approximately) is widened to all values.
3. Only values inside a bracket leave their rows.  Equal ones collapse to a count
   before the shuffle; exact prefix sums over those counts give the values at the two ranks
   that enclose the quantile.

The brackets hold about ``4 / accuracy`` of the values, so no exchange carries a whole column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators.ranking import prefix_sums
from gridlens.session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, cols: list[str], probs: tuple = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """(column, p25, p50, ...): linear interpolation between ranks, as pandas ``describe`` does; NULL for
    a column without values.  NULLs are left out."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).checkpoint(eager=True)
    edges = [min(1.0, max(0.0, p + d / accuracy)) for p in probs for d in (-2, 2)]
    sketch = data.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))],
                      *[F.percentile_approx(f"c{i}", edges, accuracy).alias(f"q{i}") for i in range(len(cols))]).first()
    # per target: column, quantile, bracket, place of the quantile among the ranks from 0
    targets = [(i, p, sketch[f"q{i}"][2 * j], sketch[f"q{i}"][2 * j + 1], (sketch[f"n{i}"] - 1) * p)
               for i in range(len(cols)) if sketch[f"n{i}"] for j, p in enumerate(probs)]
    if not targets:
        return spark.createDataFrame([(c, *[None] * len(probs)) for c in cols],
                                     "column string, " + ", ".join(f"p{int(p * 100)} double" for p in probs))
    counts = data.agg(*[e for t, (i, _, a, b, _) in enumerate(targets) for e in (
        F.count_if(F.col(f"c{i}") < a).alias(f"below{t}"), F.count_if(F.col(f"c{i}") <= b).alias(f"upto{t}"))]).first()
    rows, inside = [], []
    for t, (i, p, a, b, h) in enumerate(targets):
        below, x = counts[f"below{t}"], F.col(f"c{i}")
        fits = below <= math.floor(h) and math.ceil(h) < counts[f"upto{t}"]
        rows.append((t, cols[i], p, below if fits else 0, math.floor(h), math.ceil(h), h - math.floor(h)))
        inside.append(F.when((x >= a) & (x <= b) if fits else x.isNotNull(), F.struct(F.lit(t).alias("t"), x.alias("value"))))
    near = data.select(F.explode(F.array(*inside)).alias("s")).where("s IS NOT NULL").select("s.*") \
        .groupBy("t", "value").agg(F.count("*").alias("n"))
    near = prefix_sums(near, ["value"], ["n"], ["t"])
    table = spark.createDataFrame(rows, "t int, column string, p double, below long, lo long, hi long, part double")
    end = F.col("below") + F.col("cum_n")
    at = lambda r: F.max(F.when((end - F.col("n") <= F.col(r)) & (F.col(r) < end), F.col("value")))
    found = near.join(F.broadcast(table), "t").groupBy("column", "p", "part").agg(at("lo").alias("v_lo"), at("hi").alias("v_hi"))
    found = found.withColumn("q", F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("part"))
    wide = found.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{int(p * 100)}") for p in probs])
    return spark.createDataFrame([(c,) for c in cols], "column string").join(wide, "column", "left")
