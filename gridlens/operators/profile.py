"""Table profiling: shape, non-null counts, describe, column stats, type plan.

Every profile is one aggregation pass (partial aggregation on executors,
one row to the driver) followed by an ``unpivot`` to long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, exclude: tuple = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def _long(stats: DataFrame, cols: list[str], metrics: list[str]) -> DataFrame:
    """One wide stats row with columns '<metric>__<col>' -> rows per column."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"{m}__{c}").alias(m) for m in metrics]) for c in cols]
    return stats.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def profile_counts(df: DataFrame) -> DataFrame:
    """Row count and non-null count per column (shape / info)."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count(F.col(c)).alias(f"non_null__{c}") for c in df.columns])
    return _long(wide.withColumns({f"n_rows__{c}": F.col("__n") for c in df.columns}),
                 df.columns, ["non_null", "n_rows"])


def profile_describe(df: DataFrame, digits: int = 6, std_digits: int = 4) -> DataFrame:
    """count / mean / std (sample) / min / max per numeric column."""
    cols = numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"count__{c}"), F.round(F.avg(x), digits).alias(f"mean__{c}"),
                 F.round(F.stddev_samp(x), std_digits).alias(f"std__{c}"),
                 F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    return _long(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])


def column_stats(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"),
                 F.round(F.avg(x), digits).alias(f"mean__{c}")]
    return _long(df.agg(*aggs), cols, ["min", "max", "mean"])


def type_decisions(df: DataFrame, share: float = 0.5, error: float = 0.02, margin: float = 5.0) -> DataFrame:
    """(column, kind, planned_type, n_rows): the types of ``type_plan`` without counting distinct values.

    One aggregate row: ranges, float round trips and a HyperLogLog++ sketch per string column, each of bounded
    size.  Distinct values are counted exactly only for a column whose estimate lies within ``margin``
    standard errors of ``share``."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL)]
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    lossy = lambda c: F.col(c).cast("float").cast("double") != F.col(c).cast("double")
    found = df.agg(F.count(F.lit(1)).alias("rows"),
                   *[e for c in whole for e in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))],
                   *[F.count_if(lossy(c)).alias(f"lossy_{c}") for c in real],
                   *[F.approx_count_distinct(c, error).alias(f"nd_{c}") for c in strings]).first()
    rows, plan = found["rows"], []
    for c in whole:
        lo, hi = found[f"min_{c}"], found[f"max_{c}"]
        fits = (b for b in (8, 16, 32) if lo is not None and -2 ** (b - 1) <= lo and hi < 2 ** (b - 1))
        plan.append((c, "integer", f"int{next(fits, 64)}", rows))
    for c in real:
        plan.append((c, "float", "float64" if found[f"lossy_{c}"] else "float32", rows))
    for c in strings:
        distinct = found[f"nd_{c}"]
        if rows and abs(distinct / rows - share) <= margin * error * distinct / rows:
            distinct = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1)).count()
        plan.append((c, "string", "category" if rows and distinct / rows < share else "string", rows))
    return df.sparkSession.createDataFrame(plan, "column string, kind string, planned_type string, n_rows long")


def type_plan(df: DataFrame) -> DataFrame:
    """Narrowest lossless type per column.

    integers -> int8/int16/int32/int64 by range; doubles -> float32 when every
    value survives a float round trip; strings -> category when
    distinct/rows < 0.5 (distinct counted for string columns only).
    """
    aggs = [F.count(F.lit(1)).alias("__n")]
    kinds = {}
    for f in df.schema.fields:
        c, t = f.name, f.dataType
        if isinstance(t, INTEGRAL):
            kinds[c] = "integer"
            aggs += [F.min(c).cast("double").alias(f"min__{c}"), F.max(c).cast("double").alias(f"max__{c}")]
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            kinds[c] = "float"
            lossy = F.col(c).cast("float").cast("double") != F.col(c).cast("double")
            aggs += [F.min(c).cast("double").alias(f"min__{c}"), F.max(c).cast("double").alias(f"max__{c}"),
                     F.count_if(lossy).alias(f"lossy__{c}")]
        elif isinstance(t, T.StringType):
            kinds[c] = "string"
            aggs += [F.count_distinct(c).alias(f"nd__{c}"), F.count(c).alias(f"nn__{c}")]
    wide = df.agg(*aggs)
    rows = []
    for c, kind in kinds.items():
        if kind == "integer":
            lo, hi = F.col(f"min__{c}"), F.col(f"max__{c}")
            planned = (F.when((lo >= -128) & (hi <= 127), "int8")
                       .when((lo >= -32768) & (hi <= 32767), "int16")
                       .when((lo >= -2147483648) & (hi <= 2147483647), "int32").otherwise("int64"))
            nd = F.lit(None).cast("bigint")
        elif kind == "float":
            lo, hi = F.col(f"min__{c}"), F.col(f"max__{c}")
            planned = F.when(F.col(f"lossy__{c}") == 0, "float32").otherwise("float64")
            nd = F.lit(None).cast("bigint")
        else:
            lo = hi = F.lit(None).cast("double")
            nd = F.col(f"nd__{c}")
            planned = F.when(F.try_divide(nd, F.col("__n")) < 0.5, "category").otherwise("string")
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"),
                             lo.alias("min_value"), hi.alias("max_value"),
                             nd.alias("n_distinct"), F.col("__n").alias("n_rows"),
                             planned.alias("planned_type")))
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
