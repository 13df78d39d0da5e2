"""Model comparison: several models a task, normalised within their task."""
from conftest import SF_SMALL
from gridlens.operators import train as TR
from gridlens.plans import queries as Q

TABLE = "target string, model_type string, model_file string, task string, accuracy double, precision double, recall double, " \
        "f1_score double, mae double, mse double, rmse double, r2_score double"


def test_normalised_by_task(spark):
    rows = [("a", "ML", "m1", "classification", 0.5, 0.2, 0.3, 0.9, None, None, None, None),
            ("a", "ML", "m2", "classification", 1.0, 0.2, 0.4, 0.8, None, None, None, None),
            ("a", "ML", "m2", "classification", 1.0, 0.2, 0.4, 0.8, None, None, None, None),
            ("b", "ML", "m3", "regression", None, None, None, None, 2.0, 4.0, 2.0, 0.1),
            ("b", "ML", "m4", "regression", None, None, None, None, 1.0, 4.0, 3.0, 0.3),
            ("b", "ML", "m5", "regression", None, None, None, None, 1.5, 4.0, 4.0, 0.2)]
    table = spark.createDataFrame(rows, TABLE)
    got = {r["display_name"]: tuple(r)[2:] for r in TR.compare(table).collect()}
    assert set(got) == {"a | ML | m1", "a | ML | m2", "b | ML | m3", "b | ML | m4", "b | ML | m5"}
    assert got["a | ML | m1"] == (0.0, TR.ALL_EQUAL, 0.0, 1.0, None, None, None, None)
    assert got["b | ML | m3"] == (None, None, None, None, 1.0, TR.ALL_EQUAL, 0.0, 0.0)
    assert round(got["b | ML | m5"][7], 9) == 0.5
    only = TR.compare(table, "regression")
    assert only.columns == ["display_name", "task", "mae", "mse", "rmse", "r2_score"]
    assert only.count() == 3 and TR.compare(table, "classification").count() == 2


def test_every_kind_is_evaluated_and_compared(spark, monkeypatch):
    real = TR.estimator  # small ensembles
    monkeypatch.setattr(TR, "estimator", lambda *a, **kw: real(*a, **{**kw, "maxIter": 3, "numTrees": 5}))
    table = Q._metrics_table(spark, SF_SMALL).checkpoint()
    every = table.collect()
    assert sorted((r["task"], sum(r[c] is not None for c in TR.METRICS[r["task"]])) for r in every) == [
        ("classification", 4)] * 5 + [("regression", 4)] * 4
    assert sorted(r["model_type"] for r in every) == ["DL"] + ["ML"] * 8
    rows = [r.asDict() for r in TR.compare(table).collect()]
    assert len(rows) == len(Q.MODEL_KINDS) == 9
    for task, names in TR.METRICS.items():
        mine = [r for r in rows if r["task"] == task]
        for c in names:
            values = [r[c] for r in mine]
            assert None not in values
            assert set(values) == {TR.ALL_EQUAL} or (min(values), max(values)) == (0.0, 1.0)


def test_models_evaluated_together_equal_each_alone(spark, tmpdir_path):
    """One pass over all models of a target gives the metrics of one pass per model; rows with a
    NULL feature are left out, and a sample bounds the rest."""
    daily = Q._stored_daily(spark, SF_SMALL)
    features = ["customer_risk_score_mean", "energy_loss_ratio", "power_factor_mean"]
    for algorithm, category in (("logistic", "ml"), ("mlp", "dl")):
        ok, message = TR.train_pipeline(daily, "tamper_detected", algorithm, category, features=features, store=tmpdir_path)
        assert ok, message
    registry = spark.read.parquet(f"{tmpdir_path}/registry").collect()
    got = {r["model_file"]: r for r in TR.evaluate_models(daily, registry).collect()}
    sp = TR.split(daily, "tamper_detected", "classification", features).where("split = 'test'").dropna(subset=features)
    for r in registry:
        pred = TR.predict(TR.load_models(r["path"], r["members"]), sp, "classification")
        name = r["path"].rsplit("/", 1)[1]
        alone = TR.metrics_row(pred, "tamper_detected", "classification", name, r["category"]).first().asDict()
        assert {k: got[name][k] for k in alone} == alone
    few = TR.evaluate_models(daily, registry, sample=25)
    assert few.count() == 2 and all((r["accuracy"] * 25) % 1 < 1e-6 or (r["accuracy"] * 25) % 1 > 1 - 1e-6 for r in few.collect())


def test_folds_of_a_class_differ_by_at_most_one_row(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 7 = 0 THEN 1 ELSE 0 END AS label")
    sizes = TR.folds(rows, "label", 3, ["id"]).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        mine = [r["count"] for r in sizes if r["label"] == label]
        assert len(mine) == 3 and max(mine) - min(mine) <= 1
