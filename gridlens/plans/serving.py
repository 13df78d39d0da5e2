"""The daily summary as a served table, for dashboards that don't derive it from readings.

It is partitioned by day and bucketed by meter: filters on days prune folders, a filter on a
meter prunes buckets, and whatever groups or joins by meter needs no exchange.  The table is an
external one under the shared store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators import insights


def write_served(daily: DataFrame, name: str, path: str, buckets: int = 16) -> None:
    """Store ``daily`` as the table ``name``.  Rows are dealt by day and bucket first, so that each
    bucket of a day is one file; ``buckets`` should grow with the meters (some 128 MB a bucket and day)."""
    bucket = F.pmod(F.hash("meter_id_"), F.lit(buckets))
    (daily.repartition("date_", bucket).write.mode("overwrite").format("parquet").option("path", path)
     .partitionBy("date_").bucketBy(buckets, "meter_id_").sortBy("meter_id_").saveAsTable(name))


def newest_day(spark: SparkSession, name: str) -> str | None:
    """The last day of a served table, from its catalog entries; no data is read."""
    days = spark.sql(f"SHOW PARTITIONS {name}").select(F.substring_index("partition", "=", -1).alias("day"))
    return days.where("day != '__HIVE_DEFAULT_PARTITION__'").agg(F.max("day")).first()[0]


def newest(spark: SparkSession, name: str) -> DataFrame:
    """Rows of the last day (none for an empty table): one folder is read."""
    day = newest_day(spark, name)
    return spark.table(name).where(F.col("date_") == F.lit(day).cast("date"))


def meter_series(spark: SparkSession, name: str, meter_id: str | None = None) -> DataFrame:
    """One meter's series from its bucket; without ``meter_id`` the first in id order."""
    table = spark.table(name)
    meter = meter_id if meter_id is not None else table.agg(F.min("meter_id_")).first()[0]
    return insights.meter_series(table, meter) if meter is not None else insights.meter_series(table)
