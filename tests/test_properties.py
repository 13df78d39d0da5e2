"""Invariants: partition invariance, totals, split, risk, ROC."""
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridlens.operators import evaluate as EV
from gridlens.operators import mlprep as MP
from gridlens.operators import score as SC
from gridlens.plans import pipeline as P


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partition_invariance(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(_rows(P.daily(spark, SF_SMALL)))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rollup_totals_equal_reading_totals(spark):
    eng = P.engineered(spark, SF_SMALL)
    daily = P.daily(spark, SF_SMALL)
    a = eng.agg(F.sum("energy_consumed_kwh"), F.sum("revenue_loss"), F.sum("fault_flag"), F.count("*")).first()
    b = daily.agg(F.sum("energy_consumed_kwh_sum"), F.sum("revenue_loss_sum"), F.sum("fault_flag_sum"),
                  F.sum("supply_hours") * 0 + F.count("*")).first()
    assert a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
    # rows per meter-day = distinct engineered fault types that day
    per_day = eng.groupBy("meter_id", "date").agg(F.count_distinct("fault_type").alias("n"))
    assert per_day.agg(F.sum("n")).first()[0] == daily.count()


def test_split_disjoint_complete_stratified(spark):
    daily = P.daily(spark, SF_SMALL)
    sp = MP.stratified_split(daily.select(*MP.SPLIT_ORDER, "tamper_detected"), "tamper_detected")
    assert sp.count() == daily.count()
    assert sp.select(*MP.SPLIT_KEYS).distinct().count() == daily.count()
    for r in sp.groupBy("tamper_detected").agg(
            F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert abs(r["t"] - 0.8 * r["n"]) <= 1


def test_risk_plus_confidence_is_100(spark):
    risk = SC.risk_scores(SC.rule_scores(P.daily(spark, SF_SMALL)))
    bad = risk.where(F.abs(F.col("risk_score_pct") + F.col("confidence_score_pct") - 100) > 1e-9).count()
    assert bad == 0


def test_roc_monotone_and_ends_at_one(spark):
    roc = EV.roc_points(SC.rule_scores(P.daily(spark, SF_SMALL))).orderBy(F.col("threshold").desc()).collect()
    f = [r["fpr"] for r in roc]
    t = [r["tpr"] for r in roc]
    assert f == sorted(f) and t == sorted(t)
    assert abs(f[-1] - 1) < 1e-12 and abs(t[-1] - 1) < 1e-12


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    sc = SC.rule_scores(P.daily(spark, SF_SMALL))
    ours = EV.roc_auc(sc).first()["auc"]
    ml = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label").evaluate(
        sc.select(F.col("probability").cast("double"), F.col("label").cast("double")))
    assert abs(ours - ml) < 1e-9


def test_prefix_sums_match_pandas(spark):
    from gridlens.operators.ranking import prefix_sums
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"),
                                     (F.col("id") * 3 % 11).alias("v"))
    got = {(r["g"], r["k"]): r["cum_v"] for r in prefix_sums(df, ["k"], ["v"], ["g"], 5).collect()}
    pdf = df.toPandas().sort_values(["g", "k"])
    pdf["c"] = pdf.groupby("g")["v"].cumsum()
    for g, k, c in zip(pdf["g"], pdf["k"], pdf["c"]):
        assert got[(g, k)] == c


def test_exact_quantiles_equal_pandas_and_move_few_values(spark):
    """Ties, constants, NULLs, one value, no value; and brackets that a coarse sketch misses."""
    import numpy as np

    from gridlens.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "constant": 7.0,
                        "holes": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)), "one": [1.5] + [np.nan] * (n - 1)})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (None,) for r in pdf.itertuples(index=False)]
    cols = [*pdf.columns, "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    for accuracy in (10_000, 3):
        got = {r["column"]: (r["p25"], r["p50"], r["p75"]) for r in exact_quantiles(df, cols, accuracy=accuracy).collect()}
        for c in pdf.columns:
            assert np.allclose(got[c], pdf[c].quantile([0.25, 0.5, 0.75]).tolist(), rtol=1e-12, atol=0)
        assert got["none"] == (None, None, None) and len(got) == len(cols)


def test_runs_are_seen_only_when_whole(spark, tmpdir_path):
    import datetime as dt

    from gridlens.operators import runs as RN
    first, second = dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 4)
    rows = spark.range(5).withColumn("probability", F.col("id") / 5)
    assert RN.write_run(rows, tmpdir_path, RN.stamp_of(first), "a", "m") == 5
    # a run whose scores were written, but that was never announced
    rows.limit(1).write.parquet(f"{tmpdir_path}/runs/run={RN.stamp_of(second)}")
    got = RN.latest_run(spark, tmpdir_path)
    assert got.count() == 5 and {r.run for r in got.collect()} == {RN.stamp_of(first)}
    RN.write_run(rows.limit(2), tmpdir_path, RN.stamp_of(second))
    assert RN.latest_run(spark, tmpdir_path).count() == 2 and RN.manifest(spark, tmpdir_path).count() == 2
    assert "run=" + RN.stamp_of(first) not in " ".join(RN.latest_run(spark, tmpdir_path).inputFiles())
    # a batch with errors is neither scored nor stored
    bad = spark.createDataFrame([("m", "x")], "meter_id_ string, base__expected string")
    told = []
    scores, errors = RN.run_batch(bad, ["base__expected", "base__consumed"], lambda d: d, tmpdir_path, second, log=told.append)
    assert scores is None and not told
    assert sorted(map(tuple, errors.collect())) == [("missing_column", "base__consumed", 0), ("non_numeric", "base__expected", 1)]


def test_materialized_daily_serves_dashboards(spark, tmpdir_path):
    """Dashboards over the stored, date-partitioned daily table equal the
    lazy plan, and a date filter prunes partitions."""
    import os
    from gridlens.operators import insights as I
    path = os.path.join(tmpdir_path, "daily_store")
    P.write_daily(spark, SF_SMALL, path)
    stored = P.read_daily(spark, path)
    lazy = P.daily(spark, SF_SMALL)
    assert _rows(I.sla_by_band(stored)) == _rows(I.sla_by_band(lazy))
    assert _rows(I.alert_summary(stored)) == _rows(I.alert_summary(lazy))
    f = I.filter_daily(stored, dates=("2024-01-05", "2024-01-06"))
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date_" in plan.split("PartitionFilters")[1][:200]
    assert f.count() == I.filter_daily(lazy, dates=("2024-01-05", "2024-01-06")).count()
