"""Sources and sinks: typed CSV scans, overwrite/append, compaction, size report."""
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridlens.sources import fixtures
from gridlens.sources import io as IO
from gridlens.plans import pipeline as P


def test_csv_round_trip_with_fixed_schema(spark, tmpdir_path):
    r = fixtures.readings(spark, SF_SMALL)
    path = os.path.join(tmpdir_path, "meter_data_csv")
    IO.write_table(r, path, "csv")
    back = IO.read_readings(spark, path)
    assert back.schema == IO.READING_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, r.select(*IO.READING_SCHEMA.names).collect()))


def test_append_and_partitioned_parquet(spark, tmpdir_path):
    daily = P.daily(spark, SF_SMALL)
    path = os.path.join(tmpdir_path, "daily")
    IO.write_table(daily, path, "parquet", partition_by=["date_"])
    IO.write_table(daily.limit(3), path, "parquet", mode="append", partition_by=["date_"])
    back = spark.read.parquet(path)
    assert back.count() == daily.count() + 3
    one_day = back.where(F.col("date_") == F.lit("2024-01-05").cast("date"))
    assert "PartitionFilters: [isnotnull(date_" in one_day._jdf.queryExecution().executedPlan().toString()


def test_read_daily_csv(spark, tmpdir_path):
    daily = P.daily(spark, SF_SMALL)
    path = os.path.join(tmpdir_path, "daily_csv")
    IO.write_table(daily, path, "csv")
    back = IO.read_daily(spark, path, daily.schema)
    assert back.count() == daily.count()
    assert dict(back.dtypes)["date_"] == "date"


def test_read_typed_try_cast(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "typed.csv")
    with open(path, "w") as f:
        f.write("meter_id,energy_loss_flag_sum,pf\nA,3,0.5\nB,x,0.25\n")
    df = IO.read_typed(spark, path, {"energy_loss_flag_sum": "int", "pf": "double"})
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("A", 3, 0.5), ("B", None, 0.25)]


def test_compaction_and_size_report(spark, tmpdir_path):
    r = fixtures.readings(spark, SF_SMALL)
    src = os.path.join(tmpdir_path, "raw")
    IO.write_table(r, src, "csv")
    for fmt in ("gzip", "parquet"):
        rep = IO.compact(spark, src, os.path.join(tmpdir_path, f"out_{fmt}"), fmt).first()
        assert rep["compressed_mb"] < rep["original_mb"]
        assert 0 < rep["reduction_pct"] < 100
    gz = IO.read_readings(spark, os.path.join(tmpdir_path, "out_gzip"))
    pq = spark.read.parquet(os.path.join(tmpdir_path, "out_parquet"))
    assert gz.count() == pq.count() == r.count()


def test_compacted_files_are_narrow_and_lose_nothing(spark, tmpdir_path):
    r = fixtures.readings(spark, SF_SMALL).select(*IO.READING_SCHEMA.names)
    edge = r.limit(2).withColumns({"tamper_duration_hours": F.lit(-(2 ** 15)), "v1": F.lit(float("nan")), "event_id": F.lit(2 ** 31)})
    r = r.unionByName(edge).checkpoint()
    src = os.path.join(tmpdir_path, "raw")
    IO.write_table(r, src, "csv")
    for fmt, read in (("parquet", "parquet"), ("gzip", "csv")):
        IO.compact(spark, src, os.path.join(tmpdir_path, fmt), fmt)
        back = IO.read_readings(spark, os.path.join(tmpdir_path, fmt), read)
        want = r.withColumn("v1", F.when(~F.isnan("v1"), F.col("v1")))
        assert back.schema == IO.READING_SCHEMA
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    kinds = dict(spark.read.parquet(os.path.join(tmpdir_path, "parquet")).dtypes)
    assert kinds["tamper_flag"] == "tinyint" and kinds["tamper_duration_hours"] == "smallint" and kinds["event_id"] == "bigint"
    assert kinds["v_agg"] == "float" and kinds["expected_energy_from_vend"] == "double"


def test_increments_of_a_stored_summary_merge_to_the_full_rollup(spark, tmpdir_path):
    """Late readings of stored days, a retried increment, and a compacted table."""
    eng, path = P.engineered(spark, SF_SMALL).checkpoint(), os.path.join(tmpdir_path, "summary")
    for k in (0, 1, 2, 1):
        P.append_partials(eng.where(F.col("event_id") % 3 == k), path, str(k))
    rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    full = P.daily(spark, SF_SMALL)
    got = P.stored_daily(spark, path).select(*full.columns)
    assert got.dtypes == full.dtypes and rounded(got) == rounded(full)
    day = P.stored_daily(spark, path, "date_ = DATE'2024-01-05'")
    assert "PartitionFilters: [isnotnull(date_" in day._jdf.queryExecution().executedPlan().toString()
    assert rounded(day.select(*full.columns)) == rounded(full.where("date_ = DATE'2024-01-05'"))
    P.compact_partials(spark, path, path + "-compact")
    assert rounded(P.stored_daily(spark, path + "-compact").select(*full.columns)) == rounded(full)
