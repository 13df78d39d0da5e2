"""MLlib training sanity: separable labels, reproducibility, save/load."""
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridlens.operators import train as TR
from gridlens.plans import pipeline as P


def test_logistic_auc_and_reproducible(spark):
    daily = P.daily(spark, SF_SMALL)
    feats = ["customer_risk_score_mean", "tamper_cost_estimate_sum", "energy_loss_ratio"]
    _, pred1, _ = TR.train_and_predict(daily, "tamper_detected", "logistic", feats)
    _, pred2, _ = TR.train_and_predict(daily, "tamper_detected", "logistic", feats)
    auc = TR.score_predictions(pred1, "classification")
    assert auc > 0.5
    a = sorted(map(tuple, pred1.collect()))
    b = sorted(map(tuple, pred2.collect()))
    assert a == b


def test_pipeline_save_load_round_trip(spark, tmpdir_path):
    daily = P.daily(spark, SF_SMALL)
    ok, msg = TR.train_pipeline(daily, "energy_loss_kwh_sum", "linear", store=tmpdir_path,
                                features=["expected_energy_kwh_sum", "energy_consumed_kwh_sum"])
    assert ok, msg
    reg = spark.read.parquet(os.path.join(tmpdir_path, "registry")).first()
    models = TR.load_models(reg["path"], reg["members"])
    sp = TR.split(daily, "energy_loss_kwh_sum", "regression", list(reg["features"]))
    pred = TR.predict(models, sp.where(F.col("split") == "test"), "regression")
    r2 = TR.score_predictions(pred, "regression")
    assert r2 > 0.99  # loss = expected - consumed is linear in the features
    m = TR.metrics_row(pred, "energy_loss_kwh_sum", "regression", "m1").collect()
    assert len(m) == 1 and m[0]["r2_score"] > 0.99
    log = spark.read.parquet(os.path.join(tmpdir_path, "train_log")).first()
    assert log["status"] == "completed"


def test_invalid_pairs_are_logged(spark, tmpdir_path):
    daily = P.daily(spark, SF_SMALL)
    ok, _ = TR.train_pipeline(daily, "energy_loss_kwh_sum", "logistic", store=tmpdir_path)
    assert not ok
    ok, msg = TR.train_pipeline(daily, "tamper_detected", "x", category="rl", store=tmpdir_path)
    assert not ok and msg == "Training skipped."
    statuses = sorted(r["status"] for r in spark.read.parquet(os.path.join(tmpdir_path, "train_log")).collect())
    assert statuses == ["failed", "skipped"]


def test_sweep_shares_a_split_and_tunes(spark, tmpdir_path, monkeypatch):
    from gridlens import constants as K
    daily = P.daily(spark, SF_SMALL).checkpoint()
    made = []
    split = TR.split
    monkeypatch.setattr(TR, "split", lambda *a, **kw: made.append(a[1]) or split(*a, **kw))
    grids = {("classification", "logistic"): {"C": [0.1, 1.0]}, ("classification", "randomforest"): {"n_estimators": [2], "max_depth": [2, 3]}}
    log = TR.train_sweep(daily, {"tamper_detected": "classification"}, ml_algorithms=["logistic", "randomforest"], dl_algorithms=[],
                         store=tmpdir_path, grids=grids, exclude=K.LEAKS)
    assert made == ["tamper_detected"]
    assert {(r["algorithm"], r["status"]) for r in log.collect()} == {("logistic", "completed"), ("randomforest", "completed")}
    models = spark.read.parquet(os.path.join(tmpdir_path, "registry")).collect()
    assert len(models) == 2 and all(r["tuned"] for r in models)
    assert not any(set(r["features"]) & set(K.LEAKS["tamper_detected"]) for r in models)


def test_grid_points(spark):
    est = TR.estimator("classification", "xgboost", 2, 10)
    maps, labels = TR._param_maps(est, TR.GRIDS["classification", "xgboost"], 10)
    assert len(maps) == 12 and labels[0] == "n_estimators=50,max_depth=3,learning_rate=0.05"
    assert maps[0] == {est.maxIter: 50, est.maxDepth: 3, est.stepSize: 0.05}
    est = TR.estimator("classification", "randomforest", 2, 10)
    maps, labels = TR._param_maps(est, TR.GRIDS["classification", "randomforest"], 10)
    assert len(maps) == 9 and labels[0] == "n_estimators=50,max_depth=None" and maps[0][est.maxDepth] == TR.FOREST_DEPTH


def test_train_sweep_logs_every_pair(spark, tmpdir_path):
    daily = P.daily(spark, SF_SMALL)
    log = TR.train_sweep(daily, {"tamper_detected": "classification", "energy_loss_kwh_sum": "regression"},
                         ml_algorithms=["logistic", "linear"], dl_algorithms=["mlp"], tune=False,
                         store=tmpdir_path)
    rows = {(r["target"], r["algorithm"]): r["status"] for r in log.collect()}
    assert rows[("tamper_detected", "logistic")] == "completed"
    assert rows[("tamper_detected", "mlp")] == "completed"
    assert rows[("energy_loss_kwh_sum", "linear")] == "completed"
    assert rows[("tamper_detected", "linear")] == "failed"       # invalid pair
    assert rows[("energy_loss_kwh_sum", "logistic")] == "failed"
    assert rows[("energy_loss_kwh_sum", "mlp")] == "failed"


def test_models_of_a_target_share_preparation_and_members(spark, tmpdir_path, monkeypatch):
    """One split, one imputer and scaler a target; an ensemble's member of the same settings is not fitted again."""
    daily = P.daily(spark, SF_SMALL).checkpoint()
    splits, fits = [], []
    split, estimator = TR.split, TR.estimator
    monkeypatch.setattr(TR, "split", lambda *a, **kw: splits.append(a[1]) or split(*a, **kw))
    monkeypatch.setattr(TR, "estimator", lambda task, algorithm, *a, **kw: fits.append(algorithm) or estimator(
        task, algorithm, *a, **{**kw, "maxIter": 2, "numTrees": 2}))
    kinds = [("energy_loss_kwh_sum", a, "ml", False) for a in ("linear", "randomforest", "xgboost", "ensemble")]
    done = TR.train_all(daily, kinds, tmpdir_path)
    assert [status for status, _ in done] == ["completed"] * 4
    assert splits == ["energy_loss_kwh_sum"] and sorted(fits) == ["linear", "randomforest", "xgboost"]
    found = {r["algorithm"]: r for r in spark.read.parquet(os.path.join(tmpdir_path, "registry")).collect()}
    assert {a: r["members"] for a, r in found.items()} == {"linear": 1, "randomforest": 1, "xgboost": 1, "ensemble": 3}
    alone, voting = TR.load_models(found["linear"]["path"], 1)[0], TR.load_models(found["ensemble"]["path"], 3)[0]
    assert alone.stages[-1].coefficients == voting.stages[-1].coefficients


def test_folds_are_cut_into_few_tasks(spark, monkeypatch):
    mine = TR.prepare(P.daily(spark, SF_SMALL), "tamper_detected")
    monkeypatch.setattr(TR, "FOLD_TASKS", 2)
    rows, pairs = mine.folded()
    assert rows.rdd.getNumPartitions() <= 2 and rows.count() == mine.train.count()
    assert sum(judged.count() for _, judged in pairs) == rows.count()
    assert all(fitted.count() + judged.count() == rows.count() for fitted, judged in pairs)
    mine.release()


def test_grid_search_prepares_each_fold_once(spark, monkeypatch):
    daily = P.daily(spark, SF_SMALL).checkpoint()
    made, prep = [], TR._prep
    monkeypatch.setattr(TR, "_prep", lambda *a: made.append(a) or prep(*a))
    rows = TR.grid_search(daily, algorithm="logistic", grid={"C": [0.01, 0.1, 1.0]}).collect()
    assert len(rows) == 3 and sum(r["best"] for r in rows) == 1
    assert len(made) == TR.FOLDS + 1  # the folds, and the train rows for the winner


def test_mlp_rows_are_dealt_evenly(spark, monkeypatch):
    rows = spark.range(900).select(F.lit("train").alias("split"), (F.col("id") % 7).cast("double").alias("a"),
                                   (F.col("id") % 2).cast("double").alias("label")).coalesce(1)
    seen = []

    class Estimator:
        def fit(self, vectors):
            seen.append(vectors)

    monkeypatch.setattr(TR, "estimator", lambda *a, **kw: Estimator())
    monkeypatch.setattr(TR, "MLP_TASK_ROWS", 100)
    mine = TR.Prepared("tamper_detected", ["a"], rows)
    mine.member("mlp", {})
    mine.member("logistic", {})
    monkeypatch.setattr(TR, "MLP_TASK_ROWS", 900)
    few = TR.Prepared("tamper_detected", ["a"], rows)
    few.member("mlp", {})
    assert [v.rdd.getNumPartitions() for v in seen] == [9, 1, 1]
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 9 and sum(sizes) == 900 and max(sizes) < 110
    assert seen[0].exceptAll(seen[1]).count() == 0
    mine.release(), few.release()


WHOLE_GRIDS = {"grid_search_gbt_cls": ("classification", "xgboost"), "grid_search_gbt_reg": ("regression", "xgboost"),
               "grid_search_rf_reg": ("regression", "randomforest")}


@pytest.mark.parametrize("name", WHOLE_GRIDS)
def test_grid_queries_try_the_whole_grid(spark, monkeypatch, name):
    import gridlens.plans.queries  # noqa: F401  (registers queries)
    from gridlens.plans.registry import QUERIES
    tried = []
    monkeypatch.setattr(TR, "tune_model", lambda daily, target, features, algorithm, parallelism, grid: (
        tried.append(grid or TR.GRIDS[TR.K.TASKS[target], algorithm]), ([], None, None, None))[1])
    QUERIES[name](spark, SF_SMALL)
    assert tried == [TR.GRIDS[WHOLE_GRIDS[name]]]


def test_fewer_rounds_are_cut_from_one_fit(spark):
    """A grid fits boosted trees once for all numbers of rounds; each point is judged as if fitted alone."""
    from gridlens import constants as K
    daily = P.daily(spark, SF_SMALL).checkpoint()
    for target in ("tamper_detected", "energy_loss_kwh_sum"):
        mine = TR.prepare(daily, target, exclude=K.LEAKS[target], store=False)
        grid = {"n_estimators": [1, 3], "max_depth": [2]}
        together, _, _, _ = TR.tune_model(daily, target, None, "xgboost", grid=grid, prepared=mine)
        alone = [TR.tune_model(daily, target, None, "xgboost", grid={"n_estimators": [n], "max_depth": [2]}, prepared=mine)[0][0]
                 for n in grid["n_estimators"]]
        assert [r[:4] for r in together] == [r[:4] for r in alone]
        mine.release()


def test_rows_of_tree_fits_are_dealt_evenly_and_ordered(spark, monkeypatch):
    """Beyond FOLD_TASK_ROWS, whatever tasks the split left them in; the model of few rows stays as it was."""
    mine = TR.prepare(P.daily(spark, SF_SMALL), "energy_loss_kwh_sum")
    n = mine.train.count()
    seen, vectors = [], TR._vectors
    monkeypatch.setattr(TR, "_vectors", lambda prep, rows: seen.append(rows) or vectors(prep, rows))
    monkeypatch.setattr(TR, "FOLD_TASK_ROWS", n // 3)
    mine.member("randomforest", {"numTrees": 2, "maxDepth": 2})
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) == 4 and max(sizes) - min(sizes) < n / 20
    first = mine.features[0]
    for part in seen[0].select(first).rdd.mapPartitions(lambda it: [[r[0] for r in it]]).collect():
        assert part == sorted(part, key=lambda x: (x is not None, x))
    assert seen[0].select(*mine.features, "label").exceptAll(mine.train.select(*mine.features, "label")).isEmpty()
    to_score = TR._to_score(mine.test, mine.features, ["ensemble"])
    assert to_score.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert to_score.count() == mine.test.count() and TR._to_score(mine.test, mine.features, ["linear"]) is mine.test
    mine.release()


def test_an_ensemble_takes_its_boosted_trees_from_the_longer_fit(spark, tmpdir_path, monkeypatch):
    from gridlens import constants as K
    fits, estimator = [], TR.estimator
    monkeypatch.setattr(TR, "BOOST_ROUNDS", 3)
    monkeypatch.setattr(TR, "_members", lambda task, algorithm: [("xgboost", {"maxIter": 2})] if algorithm == "ensemble" else [(algorithm, {})])
    monkeypatch.setattr(TR, "estimator", lambda task, algorithm, *a, **kw: fits.append(kw) or estimator(task, algorithm, *a, **kw))
    daily = P.daily(spark, SF_SMALL).checkpoint()
    target = "tamper_detected"
    TR.train_all(daily, [(target, a, "ml", False) for a in ("ensemble", "xgboost")], tmpdir_path, exclude=K.LEAKS)
    assert fits == [{}]
    found = {r["algorithm"]: TR.load_models(r["path"], r["members"])[0].stages[-1]
             for r in spark.read.parquet(os.path.join(tmpdir_path, "registry")).collect()}
    alone = TR.prepare(daily, target, exclude=K.LEAKS[target]).member("xgboost", {"maxIter": 2}).stages[-1]
    assert {a: m.getNumTrees for a, m in found.items()} == {"ensemble": 2, "xgboost": 3} and len(fits) == 2
    trees = [t.toDebugString.partition("\n")[2] for t in alone.trees]
    assert [t.toDebugString.partition("\n")[2] for t in found["ensemble"].trees] == trees


def test_sweep_query_covers_every_task_and_grid(spark, monkeypatch):
    import gridlens.plans.queries as Q
    from gridlens.plans.registry import QUERIES
    from gridlens import constants as K
    asked = []
    monkeypatch.setattr(Q, "_stored_daily", lambda spark, sf: P.daily(spark, sf))

    def train_all(daily, kinds, store, grids=None, parallelism=4, exclude=None):
        asked.extend([kinds, grids or TR.GRIDS, exclude])
        TR._record(spark, store, [((TR._now(), "t", "ML", "a", "completed", 1.0, None), None, "")])

    monkeypatch.setattr(TR, "train_all", train_all)
    QUERIES["train_sweep"](spark, SF_SMALL)
    kinds, grids, exclude = asked
    ml = {"logistic", "randomforest", "xgboost", "ensemble", "linear"}
    assert {*kinds} == {(t, a, "ml", True) for t in K.TASKS for a in ml} | {(t, "mlp", "dl", False) for t in K.TASKS}
    assert grids == TR.GRIDS and exclude == K.LEAKS
