"""The standard lazy pipeline: events -> readings -> holds -> features -> daily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlens.operators.daily import daily_summary, finish, merge, partials, with_kpis
from gridlens.operators.features import engineer
from gridlens.operators.timeline import apply_holds
from gridlens.sources import fixtures


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.readings(spark, sf_dir)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_holds(fixtures.readings(spark, sf_dir, partition_by_meter_day=True), prepartitioned=True)


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineer(fixtures.readings(spark, sf_dir, partition_by_meter_day=True), prepartitioned=True)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_summary(engineered(spark, sf_dir))


def write_daily(spark: SparkSession, sf_dir: str, path: str, mode: str = "overwrite") -> None:
    """Run the pipeline once and store the daily summary partitioned by
    ``date_`` (dashboards then read it with partition pruning instead of
    re-deriving it from raw readings).  With ``mode="overwrite"`` and dynamic
    partition overwrite only the days present in the input are replaced."""
    (daily(spark, sf_dir).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("date_").parquet(path))


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_partials(engineered: DataFrame, path: str, increment: str) -> None:
    """Add readings to a stored summary without reading it: their partial aggregates are written
    under (increment, date_).  Writing an increment again replaces it, so a retry adds nothing twice."""
    (partials(engineered).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("date_").parquet(f"{path}/increment={increment}"))


def stored_daily(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The daily summary of everything that was appended; ``where`` on the group's keys is applied
    before the increments are merged, and prunes days."""
    parts = spark.read.option("basePath", path).parquet(path)
    parts = parts.where(where) if where else parts
    return with_kpis(finish(merge(parts.drop("increment"))))


def compact_partials(spark: SparkSession, path: str, dst: str) -> None:
    """Merge the increments of a stored summary into one increment of a new one."""
    merge(spark.read.option("basePath", path).parquet(path).drop("increment")).write.partitionBy("date_") \
        .parquet(f"{dst}/increment=0")
