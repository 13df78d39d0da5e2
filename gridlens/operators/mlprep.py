"""Feature preparation on the daily summary.

Statistics (means, std, correlations) are one aggregation pass producing a
single row, used as a scalar subquery (no ``over ()`` window, which would
put every row into one task, and no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens import constants as K
from gridlens.operators.profile import numeric_columns
from gridlens.operators.ranking import positions

KEYS = [k + "_" for k in K.DAILY_KEYS]
SPLIT_KEYS = ["meter_id_", "date_", "fault_type_"]
#: the full grain with the split keys first: rows of a meter that changes band on a day have an order too
SPLIT_ORDER = [*SPLIT_KEYS, *[k for k in KEYS if k not in SPLIT_KEYS]]


def feature_columns(daily: DataFrame, target: str, selected: list[str] | None = None) -> list[str]:
    """Numeric columns except ids/text and the target (or the given list).
    Raises when a requested column is missing or not numeric."""
    numeric = numeric_columns(daily.drop(*[c for c in K.NON_FEATURE_COLUMNS if c in daily.columns]))
    if target not in daily.columns:
        raise ValueError(f"target column {target!r} not found")
    if selected:
        missing = [c for c in selected if c not in daily.columns]
        if missing:
            raise ValueError(f"features missing from dataset: {missing}")
        bad = [c for c in selected if c not in numeric]
        if bad:
            raise ValueError(f"non-numeric features: {bad}")
        return list(selected)
    return [c for c in numeric if c != target]


def ml_matrix(daily: DataFrame, target: str, selected: list[str] | None = None) -> DataFrame:
    return daily.select(*feature_columns(daily, target, selected), target)


def impute_mean(daily: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """NULLs become the column's mean, rounded to ``digits`` where given."""
    mean = (lambda c: F.avg(c)) if digits is None else (lambda c: F.round(F.avg(c), digits))
    means = daily.agg(F.struct(*[mean(c).alias(c) for c in cols]).alias("m")).scalar()
    return daily.select(*[c for c in daily.columns if c not in cols],
                        *[F.coalesce(F.col(c).cast("double"), means[c]).alias(c) for c in cols])


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a zero-variance column maps to 0."""
    st = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                         *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).alias("st")).scalar()
    z = {c: F.when(st[f"s_{c}"] == 0, F.lit(0.0)).otherwise((F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"]) for c in cols}
    return df.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def stratified_split(daily: DataFrame, label: str, test_size: float = 0.2,
                     order: list[str] | None = None) -> DataFrame:
    """Exact per-class split: within each class the first
    ``n_c - ceil(test_size * n_c)`` rows in ``order`` (the full grain) go to train."""
    order = order or SPLIT_ORDER
    ranked = positions(daily, order, [label], name="__pos")
    # counted from the checkpointed ranking, not by re-deriving the input
    counts = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("__n_class"))
    # one row per class; rows without a label keep a NULL split
    out = ranked.join(counts, ranked[label].eqNullSafe(counts[label])).drop(counts[label])
    n_train = F.col("__n_class") - F.ceil(F.col("__n_class") * test_size)
    return out.withColumn("split", F.when(F.col(label).isNull(), F.lit(None).cast("string"))
                          .when(F.col("__pos") <= n_train, "train").otherwise("test")) \
        .drop("__pos", "__n_class")


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Reproducible n-row sample: smallest seeded hashes of the keys (a bounded TakeOrdered),
    rows with equal keys in the order of the full grain."""
    order = [*keys, *[k for k in KEYS if k in df.columns and k not in keys]]
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.orderBy(mark, *order).limit(n)


def target_correlation(df: DataFrame, target: str, cols: list[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of each column with the target, strongest first, NULL for constant
    columns (covar_pop / (std_pop * std_pop) under try_divide)."""
    y = F.col(target).cast("double")
    aggs = [F.round(F.try_divide(F.covar_pop(F.col(c).cast("double"), y),
                                 F.stddev_pop(F.col(c).cast("double")) * F.stddev_pop(y)), digits)
            .alias(c) for c in cols]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in cols])).alias("s")) \
        .select("s.*").orderBy(F.col("correlation").desc_nulls_last(), "feature")


def top_features(corr: DataFrame, k: int = 6) -> DataFrame:
    return corr.where(F.col("correlation").isNotNull()) \
        .orderBy(F.abs("correlation").desc(), "feature").limit(k)
