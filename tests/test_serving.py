"""The served daily table: what its plans read and shuffle, and that results stay the same."""
import re
import uuid

import pytest

from conftest import SF_SMALL
from gridlens.operators import insights as I
from gridlens.plans import pipeline as P
from gridlens.plans import serving as SV


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    name = f"served_{uuid.uuid4().hex[:8]}"
    SV.write_served(P.daily(spark, SF_SMALL), name, str(tmp_path_factory.mktemp("served") / "daily"), buckets=4)
    return name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))


def test_days_prune_folders(spark, served):
    got = I.filter_daily(spark.table(served), dates=("2024-01-03", "2024-01-05"))
    want = I.filter_daily(P.daily(spark, SF_SMALL), dates=("2024-01-03", "2024-01-05"))
    assert rows(got) == rows(want)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(got)).group(1)
    assert "date_" in filters and ">=" in filters
    days = {f.split("date_=")[1][:10] for f in got.inputFiles()}
    assert days == {"2024-01-03", "2024-01-04", "2024-01-05"}


def test_a_meter_reads_one_bucket(spark, served):
    got = SV.meter_series(spark, served)
    assert rows(got) == rows(I.meter_series(P.daily(spark, SF_SMALL)))
    for key in ("maxPartitionBytes", "openCostInBytes"):  # a task per file
        spark.conf.set(f"spark.sql.files.{key}", "1m")
    try:
        everything = spark.table(served).select("meter_id_").rdd.getNumPartitions()
        one = spark.table(served).where("meter_id_ = 'MTR_000000'").select("meter_id_").rdd.getNumPartitions()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    days = spark.sql(f"SHOW PARTITIONS {served}").count()
    assert one <= days < everything


def test_grouping_by_meter_needs_no_exchange(spark, served):
    got = I.top_efficiency(spark.table(served))
    assert "hashpartitioning" not in plan(got) and "Bucketed: true" in plan(got)
    assert [r[0] for r in got.collect()] == [r[0] for r in I.top_efficiency(P.daily(spark, SF_SMALL)).collect()]
    alerts = I.alert_summary(spark.table(served))
    assert "hashpartitioning" not in plan(alerts)


def test_newest_day_reads_one_folder(spark, served):
    got = SV.newest(spark, served)
    assert rows(got) == rows(I.latest_partition(P.daily(spark, SF_SMALL)))
    assert len({f.rsplit("/", 1)[0] for f in got.inputFiles()}) == 1 or SV.newest_day(spark, served) in plan(got)


def test_a_day_and_bucket_is_one_file(spark, served):
    files = spark.table(served).inputFiles()
    places = [(f.split("date_=")[1][:10], re.search(r"_(\d{5})\.c", f).group(1)) for f in files]
    assert len(places) == len(set(places))


def test_an_empty_table(spark, tmp_path):
    name = f"served_{uuid.uuid4().hex[:8]}"
    SV.write_served(P.daily(spark, SF_SMALL).limit(0), name, str(tmp_path / "daily"), buckets=2)
    assert SV.newest_day(spark, name) is None
    assert SV.newest(spark, name).count() == 0 and SV.meter_series(spark, name).count() == 0


def test_type_decisions_count_only_close_columns(spark):
    from pyspark.sql import functions as F
    from gridlens.operators import profile as PR
    # 500 rows: one far below half, one far above, two next to it on either side
    df = spark.range(500).select(
        (F.col("id") % 5).cast("string").alias("few"), F.col("id").cast("string").alias("all"),
        (F.col("id") % 249).cast("string").alias("below"), (F.col("id") % 250).cast("string").alias("at"),
        F.lit(None).cast("string").alias("none"), (F.col("id") * 0.1).alias("x"), (F.col("id") - 200).alias("n"))
    got = {r["column"]: r["planned_type"] for r in PR.type_decisions(df).collect()}
    want = {r["column"]: r["planned_type"] for r in PR.type_plan(df).collect()}
    assert got == want == {"few": "category", "all": "string", "below": "category", "at": "string", "none": "category",
                           "x": "float64", "n": "int16"}
    assert {r["planned_type"] for r in PR.type_decisions(df.limit(0)).where("kind = 'string'").collect()} == {"string"}


def test_operators_keep_full_precision(spark):
    from gridlens.operators import mlprep as MP
    df = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (None,)], "x double")
    assert MP.impute_mean(df, ["x"]).agg({"x": "max"}).first()[0] == 1.0
    assert sorted(r[0] for r in MP.impute_mean(df, ["x"]).collect())[2] == 1 / 3
    z = [r[0] for r in MP.standardize(df.dropna(), ["x"]).collect()]
    assert abs(sum(v * v for v in z) - 3) < 1e-12
    meters = spark.createDataFrame([("a", 0.5), ("b", 0.5 + 1e-12)], "meter_id_ string, energy_efficiency_ratio double")
    assert [r[0] for r in I.top_efficiency(meters, 1).collect()] == ["b"]
    assert [r[0] for r in I.top_efficiency(meters, 1, digits=9).collect()] == ["a"]


def test_risky_meters_are_distinct(spark):
    from gridlens.operators import score as SC
    rows = spark.createDataFrame([("a", 90.0, 1), ("a", 95.0, 1), ("b", 95.0, 1), ("c", None, None)],
                                 "meter_id_ string, risk_score_pct double, risk_alert int")
    assert [tuple(r) for r in SC.top_risk_meters(rows).collect()] == [("a", 95.0, 2, 2), ("b", 95.0, 1, 1)]
