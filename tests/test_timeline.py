"""Day-bucketed timeline rules vs a plain-Python row loop over each meter's
whole history (the reference's sequential semantics)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridlens.operators import timeline
from gridlens.operators.features import engineer
from gridlens.operators.timeline import meter_timeline
from gridlens.sources import fixtures


def loop_reference(rows, n_roll=24):
    """rows: dicts of one meter sorted by (timestamp, event_id)."""
    out = []
    frec = trec = None
    prev = None
    held_faults = []
    for r in rows:
        ts = r["timestamp"]
        if r["fault_flag"] == 1:
            frec = (ts, r["fault_duration_hours"], r["fault_type"])
        if r["tamper_flag"] == 1:
            trec = (ts, r["tamper_duration_hours"])
        f_on = frec is not None and ts - frec[0] <= dt.timedelta(hours=frec[1])
        t_on = trec is not None and ts - trec[0] <= dt.timedelta(hours=trec[1])
        status = "faulty" if f_on else "tampered" if t_on else "inactive" if r["data_transmitted"] == 0 else "healthy"
        held_faults.append(int(f_on))
        out.append({
            "event_id": r["event_id"], "fault_flag": int(f_on), "fault_type": frec[2] if f_on else None,
            "fault_duration_hours": frec[1] if f_on else 0, "tamper_flag": int(t_on),
            "tamper_duration_hours": trec[1] if t_on else 0, "meter_status": status,
            "prev_pf": prev["pf"] if prev else None, "prev_status": prev["status"] if prev else None,
            "prev_fault": prev["fault"] if prev else None, "prev_tamper": prev["tamper"] if prev else None,
            "rolling": float(sum(held_faults[-n_roll:])),
        })
        prev = {"pf": r["power_factor"], "status": status, "fault": int(f_on), "tamper": int(t_on)}
    return out


def _check(spark, readings, n_roll=24):
    got = meter_timeline(readings, n_roll).select(
        "meter_id", "event_id", "fault_flag", "fault_type", "fault_duration_hours", "tamper_flag",
        "tamper_duration_hours", "meter_status", F.col("__prev_power_factor").alias("prev_pf"),
        F.col("__prev_meter_status").alias("prev_status"), F.col("__prev_fault_flag").alias("prev_fault"),
        F.col("__prev_tamper_flag").alias("prev_tamper"), F.col("unresolved_fault_days").alias("rolling"))
    got = {r["event_id"]: r.asDict() for r in got.collect()}
    by_meter = {}
    for r in readings.orderBy("meter_id", "timestamp", "event_id").collect():
        by_meter.setdefault(r["meter_id"], []).append(r.asDict())
    n = 0
    for rows in by_meter.values():
        for exp in loop_reference(rows, n_roll):
            g = got[exp["event_id"]]
            for k, v in exp.items():
                assert g[k] == v, (k, exp["event_id"], g[k], v)
            n += 1
    assert n == len(got)


def test_timeline_matches_row_loop_on_fixture(spark):
    _check(spark, fixtures.readings(spark, SF_SMALL))


@pytest.mark.parametrize("n_roll", [1, 2, 5])
def test_rolling_window_sizes(spark, n_roll):
    _check(spark, fixtures.readings(spark, SF_SMALL), n_roll)


def test_edge_cases(spark):
    """first row of a meter, exact elapsed == duration, gaps of several empty
    days, ties in timestamp (broken by event_id), NULL fault type."""
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    base = dict(phase_type="three", v1=None, v2=None, v3=None, i1=None, i2=None, i3=None, v_agg=230.0,
                i_agg=10.0, energy_consumed_kwh=1.0, expected_energy_kwh=1.0, signal_strength_dbm=-50.0,
                data_transmitted=1, reading_gap_minutes=60, location_id="Ojo", feeder_id="F",
                transformer_id="T", band="B", tariff_per_kwh=61.0, total_vended_amount=500.0,
                expected_energy_from_vend=8.2, meter_status="healthy")
    spec = [  # (meter, event_id, ts, fault, dur, type, tamper, tdur, pf, transmitted)
        ("M1", 1, t0, 1, 2, "low_voltage", 0, 0, 0.5, 1),
        ("M1", 2, t0 + dt.timedelta(hours=2), 0, 0, None, 0, 0, 0.6, 1),          # elapsed == duration
        ("M1", 3, t0 + dt.timedelta(hours=2, microseconds=1), 0, 0, None, 0, 0, 0.7, 0),
        ("M1", 4, t0 + dt.timedelta(days=3), 0, 0, None, 1, 30, 0.8, 1),        # empty days before
        ("M1", 5, t0 + dt.timedelta(days=4, hours=1), 0, 0, None, 0, 0, 0.9, 1),  # within 30h
        ("M1", 6, t0 + dt.timedelta(days=4, hours=1), 1, 100, "modem_disconnect", 0, 0, 0.1, 1),  # tie
        ("M1", 7, t0 + dt.timedelta(days=8), 0, 0, None, 0, 0, 0.2, 1),         # 100h later, still held
        ("M2", 8, t0, 0, 0, None, 0, 0, 1.0, 0),
    ]
    rows = []
    for m, eid, ts, f, d, ty, t, td, pf, tx in spec:
        r = dict(base, meter_id=m, event_id=eid, timestamp=ts, fault_flag=f, fault_duration_hours=d,
                 fault_type=ty, tamper_flag=t, tamper_duration_hours=td, power_factor=pf, data_transmitted=tx)
        rows.append(r)
    from gridlens.sources.io import READING_SCHEMA
    df = spark.createDataFrame([tuple(r[f.name] for f in READING_SCHEMA.fields) for r in rows], READING_SCHEMA)
    _check(spark, df, 3)


def test_engineered_has_reference_columns(spark):
    df = engineer(fixtures.readings(spark, SF_SMALL))
    for c in ("hour", "day", "month", "weekday", "date", "supply_voltage_flag", "uptime_flag",
              "expected_energy_pf_calc", "pf_delta", "prev_status", "status_change", "fault_start",
              "tamper_start", "fault_timestamp", "tamper_timestamp", "energy_loss_kwh", "revenue_loss",
              "energy_loss_flag", "tamper_cost_estimate", "supply_hour_counter", "band_compliance",
              "band_compliance_max", "high_vend_zone", "is_industrial", "supply_outage_flag",
              "load_generation_gap", "load_gap_flag", "service_availability_ratio",
              "unresolved_fault_days", "meter_anomaly_tag", "customer_risk_score"):
        assert c in df.columns


def test_holds_ignore_session_time_zone(spark):
    """Elapsed hours are measured on naive timestamps: a DST change in the
    session zone must not move a hold boundary."""
    t0 = dt.datetime(2024, 3, 10, 1, 30)
    from gridlens.sources.io import READING_SCHEMA
    base = dict(phase_type="three", v1=None, v2=None, v3=None, i1=None, i2=None, i3=None, v_agg=230.0,
                i_agg=10.0, power_factor=0.9, energy_consumed_kwh=1.0, expected_energy_kwh=1.0,
                signal_strength_dbm=-50.0, data_transmitted=1, tamper_flag=0, tamper_duration_hours=0,
                meter_status="healthy", reading_gap_minutes=60, location_id="Ojo", feeder_id="F",
                transformer_id="T", band="B", tariff_per_kwh=61.0, total_vended_amount=500.0,
                expected_energy_from_vend=8.2, meter_id="M1")
    rows = [dict(base, event_id=1, timestamp=t0, fault_flag=1, fault_duration_hours=1, fault_type="low_voltage"),
            dict(base, event_id=2, timestamp=t0 + dt.timedelta(hours=2), fault_flag=0, fault_duration_hours=0,
                 fault_type=None)]
    df = spark.createDataFrame([tuple(r[f.name] for f in READING_SCHEMA.fields) for r in rows], READING_SCHEMA)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r["event_id"]: r["fault_flag"] for r in meter_timeline(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {1: 1, 2: 0}


def test_hot_meter_is_split_across_tasks_and_exact(spark):
    """One meter holding a third of all readings: results still equal the
    row loop, and its rows are spread over many partitions (by day)."""
    r = fixtures.readings(spark, SF_SMALL)
    hot = r.withColumn("meter_id", F.when(F.col("event_id") % 3 == 0, F.lit("MTR_HOT")).otherwise(F.col("meter_id")))
    _check(spark, hot)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = (meter_timeline(hot).where(F.col("meter_id") == "MTR_HOT")
                 .select(F.spark_partition_id().alias("p")).distinct().count())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert parts >= 4  # 8 shuffle partitions, ~30 days of the hot meter


@pytest.mark.parametrize("segment_rows", [1, 7, 40])
def test_hot_meter_day_is_cut_into_segments_and_exact(spark, segment_rows):
    """One meter-day with a third of all readings: every result equals the row loop, and
    the day's rows are spread over several tasks."""
    r = fixtures.readings(spark, SF_SMALL)
    hot = F.col("event_id") % 3 == 0
    micros = F.col("event_id") * 61_000_000 % 86_400_000_000
    r = r.withColumns({"meter_id": F.when(hot, F.lit("MTR_HOT")).otherwise(F.col("meter_id")),
                       "timestamp": F.when(hot, F.timestamp_add("MICROSECOND", micros, F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")))
                       .otherwise(F.col("timestamp"))})
    r = r.checkpoint()
    cuts = timeline.day_cuts(r, segment_rows)
    cut = timeline.segmented(r, cuts)
    n = r.where("meter_id = 'MTR_HOT'").count()
    sizes = [x["count"] for x in cut.where("meter_id = 'MTR_HOT'").groupBy(timeline.SEGMENT).count().collect()]
    assert sum(sizes) == n and len(sizes) > 4 and max(sizes) <= max(3 * segment_rows, 3)
    _check(spark, cut)
    _check(spark, cut, 2)
    got = engineer(cut).checkpoint()
    want = engineer(r)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = (meter_timeline(cut).where(F.col("meter_id") == "MTR_HOT").select(F.spark_partition_id().alias("p")).distinct().count())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert parts >= 4


def test_days_within_the_limit_are_not_cut(spark):
    r = fixtures.readings(spark, SF_SMALL)
    assert timeline.day_cuts(r) is None
    assert timeline.day_cuts(r, 999) is None
    assert timeline.SEGMENT not in timeline.segmented(r, None).columns
