"""Structured Streaming jobs equal the batch operators on closed days."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridlens.operators.daily import daily_summary
from gridlens.operators.features import engineer
from gridlens.operators.timeline import apply_holds
from gridlens.sources import fixtures
from gridlens.streaming import jobs as J


def _files_by_week(spark, path):
    r = fixtures.readings(spark, SF_SMALL).withColumn("wk", F.weekofyear("timestamp"))
    for (wk,) in r.select("wk").distinct().orderBy("wk").collect():
        r.where(F.col("wk") == wk).drop("wk").coalesce(1).write.mode("append").parquet(path)
    return r.drop("wk")


def _run(query_builder, tmp, name):
    q = query_builder.option("checkpointLocation", os.path.join(tmp, name + "_ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_tag_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    batch = _files_by_week(spark, src)
    stream = J.tag_stream(J.read_stream(spark, src, max_files=1))
    out = os.path.join(tmpdir_path, "tagged")
    _run(stream.select("event_id", "meter_anomaly_tag", "customer_risk_score").writeStream.format("parquet")
         .option("path", out), tmpdir_path, "s1")
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    exp = sorted(map(tuple, J.tag_stream(batch).select("event_id", "meter_anomaly_tag", "customer_risk_score").collect()))
    assert got == exp


def test_daily_stream_closed_days_equal_batch_and_alerts(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    batch = _files_by_week(spark, src)
    daily = J.daily_stream(J.tag_stream(J.read_stream(spark, src, max_files=1)))
    out = os.path.join(tmpdir_path, "daily")
    _run(daily.writeStream.format("parquet").option("path", out).outputMode("append"), tmpdir_path, "s2")
    got = spark.read.parquet(out)
    last_day = batch.agg(F.max(F.to_date("timestamp"))).first()[0]
    exp_stream = J.tag_stream(batch.withColumn("event_time", F.col("timestamp").cast("timestamp")))
    exp = exp_stream.groupBy(F.to_date("timestamp").alias("date_"), *[F.col(k).alias(k + "_") for k in J.STREAM_KEYS]) \
        .agg(F.sum("energy_consumed_kwh").alias("e"), F.sum("fault_flag").cast("bigint").alias("f"),
             F.count(F.lit(1)).alias("n"))
    exp = exp.where(F.col("date_") < F.lit(last_day))
    g = got.select("date_", *[k + "_" for k in J.STREAM_KEYS], F.col("energy_consumed_kwh_sum").alias("e"),
                   F.col("fault_flag_sum").alias("f"), F.col("n_readings").alias("n"))
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, exp.collect()))
    # S3: alerts from the closed days through foreachBatch
    alerts = os.path.join(tmpdir_path, "alerts")
    stream2 = J.daily_stream(J.tag_stream(J.read_stream(spark, src, max_files=1)))
    _run(stream2.writeStream.foreachBatch(J.alert_sink(alerts)).outputMode("append"), tmpdir_path, "s3")
    n_burnt = g.count() and got.where(F.col("fault_type_") == "burnt_meter").count()
    if n_burnt:
        assert spark.read.parquet(alerts).where(F.col("alert") == "burnt_meter").count() == n_burnt


def _out_of_order_files(spark, path):
    """Readings in files of two weeks, each day split over both and the later half of a
    week first; then one reading far in the future, which closes every day."""
    r = fixtures.readings(spark, SF_SMALL).checkpoint()
    part = F.floor(F.dayofyear("timestamp") / 7) * 2 + F.col("event_id") % 2
    for (k,) in r.select(part.alias("k")).distinct().orderBy("k").collect():
        r.where(part == k).orderBy(F.desc("timestamp")).coalesce(1).write.mode("append").parquet(path)
    end = r.limit(1).withColumns({"meter_id": F.lit("MTR_END"), "timestamp": F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")})
    end.coalesce(1).write.mode("append").parquet(path)
    return r


def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_hold_stream_equals_batch_holds(spark, tmpdir_path):
    """Rows of a day come in several files and out of order."""
    _rocks(spark)
    src, out = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "held")
    batch = _out_of_order_files(spark, src)
    held = J.hold_stream(J.read_stream(spark, src, max_files=1), watermark="20 days")
    _run(held.writeStream.format("parquet").option("path", out).outputMode("append"), tmpdir_path, "s4")
    cols = ["event_id", "fault_flag", "fault_type", "tamper_flag", "meter_status"]
    edges = ["status_change", "fault_start", "tamper_start"]
    got = spark.read.parquet(out).where("meter_id <> 'MTR_END'").select(*cols, *edges)
    exp = engineer(batch).select("event_id", *edges).join(apply_holds(batch).select(*cols), "event_id").select(*cols, *edges)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, exp.collect()), key=repr)


def test_daily_summary_stream_equals_the_batch_on_every_column(spark, tmpdir_path):
    _rocks(spark)
    src, out = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "daily")
    batch = _out_of_order_files(spark, src)
    daily = J.daily_summary_stream(J.read_stream(spark, src, max_files=2), watermark="20 days")
    _run(daily.writeStream.format("parquet").option("path", out).outputMode("append"), tmpdir_path, "de")
    got, exp = spark.read.parquet(out).where("meter_id_ <> 'MTR_END'"), daily_summary(engineer(batch))
    assert got.columns == exp.columns
    rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    assert rounded(got) == rounded(exp)


@pytest.mark.parametrize("cuts", [[], [1], [3, 4, 9], list(range(1, 14))])
def test_scan_does_not_depend_on_where_a_meter_is_cut(cuts):
    rows = pd.DataFrame({
        "us": np.arange(14) * 3_600_000_000, "event_id": range(14), "power_factor": [0.1 * k for k in range(14)],
        "fault_flag": [0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0], "fault_type": [None, "a", None, None, None, None, *[None] * 8],
        "fault_duration_hours": [0, 2, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0], "tamper_flag": [0] * 8 + [1] + [0] * 5,
        "tamper_duration_hours": [0] * 8 + [1] + [0] * 5, "data_transmitted": [1, 1, 1, 1, 0] + [1] * 9})
    whole, past = J.scan_rows(rows, None, 3)
    assert whole["fault_flag"].tolist() == [0, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert whole["meter_status"].tolist()[8:11] == ["faulty", "tampered", "healthy"]
    assert whole["unresolved_fault_days"].tolist() == [0, 1, 2, 3, 2, 2, 2, 3, 3, 2, 1, 0, 0, 0]
    parts, state = [], None
    for lo, hi in zip([0, *cuts], [*cuts, 14]):
        out, state = J.scan_rows(rows.iloc[lo:hi].reset_index(drop=True), state, 3)
        parts.append(out)
    assert pd.concat(parts, ignore_index=True).astype(object).where(lambda x: x.notna(), None).equals(
        whole.astype(object).where(lambda x: x.notna(), None)) and state == past


def test_late_rows_beyond_watermark_are_dropped(spark, tmpdir_path):
    """Day 2 is emitted in run 1; re-sending day 2 in run 2 (behind the
    watermark) must not change it, while day 11 still flows."""
    src = os.path.join(tmpdir_path, "src")
    r = fixtures.readings(spark, SF_SMALL).withColumn("d", F.to_date("timestamp"))
    r.where(F.col("d") <= F.lit("2024-01-10").cast("date")).drop("d").coalesce(1).write.parquet(src, mode="append")
    out = os.path.join(tmpdir_path, "daily")

    def run():
        q = (J.daily_stream(J.tag_stream(J.read_stream(spark, src, max_files=1))).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", os.path.join(tmpdir_path, "ckpt"))
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None

    run()
    day2 = F.col("date_") == F.lit("2024-01-02").cast("date")
    first = sorted(map(tuple, spark.read.parquet(out).where(day2).collect()))
    assert first
    late = r.where(F.col("d").isin(F.lit("2024-01-02").cast("date"), F.lit("2024-01-11").cast("date"))).drop("d")
    late.coalesce(1).write.parquet(src, mode="append")
    run()
    after = spark.read.parquet(out)
    assert sorted(map(tuple, after.where(day2).collect())) == first
    # day 11 is still open (its window closes only when later data arrives)
    assert after.where(F.col("date_") == F.lit("2024-01-11").cast("date")).count() == 0
    assert after.where(F.col("date_") == F.lit("2024-01-10").cast("date")).count() > 0


def test_retried_alert_batch_replaces_its_rows(spark, tmpdir_path):
    daily = spark.sql("""SELECT 'm1' AS meter_id_, DATE '2024-01-02' AS date_, 'burnt_meter' AS fault_type_,
                                2e5 AS revenue_loss_sum, 1 AS is_industrial_, 'E' AS band_, 4L AS supply_voltage_flag_sum""")
    write = J.alert_sink(os.path.join(tmpdir_path, "alerts"))
    for batch_id in (0, 0, 1):
        write(daily, batch_id)
    got = spark.read.parquet(os.path.join(tmpdir_path, "alerts")).groupBy("batch_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2), (1, 2)]


def test_sla_alerts_count_the_hours_of_the_whole_day(spark):
    daily = spark.sql("""SELECT *, DATE '2024-01-02' AS date_, 0D AS revenue_loss_sum, 0 AS is_industrial_ FROM VALUES
                         ('m1', 'E', 'none', 2L), ('m1', 'E', 'cable', 2L), ('m2', 'E', 'none', 3L), ('m3', 'A', 'none', 19L)
                         AS t(meter_id_, band_, fault_type_, supply_voltage_flag_sum)""")
    got = J.alert_rows(daily).select("alert", "meter_id_").collect()
    assert sorted(map(tuple, got)) == [("sla_fail", "m2"), ("sla_fail", "m3")]


def test_daily_stream_drops_null_keys(spark):
    rows = J.tag_stream(fixtures.readings(spark, SF_SMALL).withColumn("event_time", F.col("timestamp").cast("timestamp")))
    hole = rows.withColumn("band", F.when(F.col("event_id") % 2 == 0, F.col("band")))
    got = J.daily_stream(hole).agg(F.sum("n_readings"), F.count_if(F.col("band_").isNull())).first()
    assert tuple(got) == (rows.where("event_id % 2 = 0").dropna(subset=J.STREAM_KEYS).count(), 0)
