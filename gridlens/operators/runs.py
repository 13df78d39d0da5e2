"""Stored runs of scores: validate, derive, score, store, log as one flow.

A run is a folder ``run=<stamp>`` below its base; its row in the manifest is written last.  Readers take
runs from the manifest only, so a run that was lost half-way is never seen, and the newest
run is found without reading any scores.  Writing a stamp again replaces the run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators import score as SC

MANIFEST = "run string, rows long, source string, model string"


def stamp_of(when: dt.datetime) -> str:
    """Stamps order as their times do."""
    return when.strftime("%Y%m%dT%H%M%S%f")


def write_run(df: DataFrame, base: str, stamp: str, source: str = "", model: str = "") -> int:
    """Store a run and then announce it; its number of rows."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{base}/runs/run={stamp}")
    rows = spark.read.parquet(f"{base}/runs/run={stamp}").count()
    spark.createDataFrame([(stamp, rows, source, model)], MANIFEST).coalesce(1) \
        .write.mode("overwrite").parquet(f"{base}/manifest/entry={stamp}")
    return rows


def manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/entry=*")


def latest_run(spark: SparkSession, base: str) -> DataFrame:
    """The scores of the newest whole run, with its stamp: one folder is read."""
    newest = manifest(spark, base).agg(F.max("run")).first()[0]
    return spark.read.parquet(f"{base}/runs/run={newest}").withColumn("run", F.lit(newest))


def run_batch(batch: DataFrame, template: list[str], score: Callable[[DataFrame], DataFrame], base: str, when: dt.datetime,
              band: str = "C", source: str = "", model: str = "", max_rows: int = 10_000_000,
              log: Callable[[int], None] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(scores of the stored run or None, validation errors).

    ``batch`` has the template's ``base__`` and ``direct__`` columns.  A batch with an error is
    not scored.  ``score`` gets the derived features and returns rows with ``probability``; the risk
    columns are added, the run is stored, and ``log`` hears its number of rows."""
    errors = SC.batch_validation(batch, template, max_rows)
    if errors.limit(1).count():
        return None, errors
    scored = SC.risk_scores(score(SC.derive_features(batch, band)))
    rows = write_run(scored, base, stamp_of(when), source, model)
    if log is not None:
        log(rows)
    return latest_run(batch.sparkSession, base), errors
