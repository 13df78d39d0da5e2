"""Model training with MLlib (H1-H12), batch scoring (J6) and evaluation
sweeps (I11).

The reference fits scikit-learn models on one machine.  Here every fit is
an MLlib ``Pipeline([Imputer, VectorAssembler, StandardScaler, estimator])``
trained on the split's train rows only, so the scaler is fitted on train
data and saved inside the model (the reference refits a scaler at scoring
time).  XGBoost is not available; gradient-boosted trees are MLlib GBTs.
"""

from __future__ import annotations

import datetime as dt
import itertools
import os
import threading
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, \
    RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import constants as K
from gridlens.operators import mlprep
from gridlens.operators.ranking import positions
from gridlens.session import ensure_checkpoint_dir

SEED = 42
#: the full grain of the daily summary: it orders splits and folds without ties
KEYS = mlprep.KEYS
#: Trees of a forest end at this depth and keep this many rows a leaf: a tree of depth d
#: has up to 2^d nodes, and all trees of a model pass through the driver.
FOREST_DEPTH = 12
FOREST_LEAF_ROWS = 2
BOOST_ROUNDS = 100
FOLDS = 3
#: A fit runs hundreds of jobs over its rows: folds of a grid search are cut into no more tasks than these, or
#: one per FOLD_TASK_ROWS rows, as more spend their time on starting.
FOLD_TASKS = 32
FOLD_TASK_ROWS = 40_000
#: A pass of a tree fit reads every row for every tree: beyond FOLD_TASK_ROWS its rows are dealt evenly, over as many
#: tasks as run at once and no more than so many rows a task.
TREE_TASK_ROWS = 250_000
TREES = ("randomforest", "xgboost")
#: An iteration of the MLP computes long on each row: beyond so many rows they are dealt evenly over tasks of as many.
MLP_TASK_ROWS = 10_000
CLASSIFIERS = ["logistic", "randomforest", "xgboost", "ensemble", "mlp"]
REGRESSORS = ["randomforest", "xgboost", "linear", "ensemble"]
#: the points that tuning tries; a depth of None is FOREST_DEPTH
GRIDS = {
    ("classification", "logistic"): {"C": [0.01, 0.1, 1.0, 10.0]},
    ("classification", "randomforest"): {"n_estimators": [50, 100, 150], "max_depth": [None, 10, 20]},
    ("classification", "xgboost"): {"n_estimators": [50, 100], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1]},
    ("regression", "randomforest"): {"max_depth": [5, 10, 15]},
    ("regression", "xgboost"): {"max_depth": [3, 6, 10]},
}
#: A reduced grid: fewer points, fewer and shallower trees.
REDUCED_GRIDS = {
    ("classification", "randomforest"): {"n_estimators": [5, 10], "max_depth": [3, 5]},
}


def default_features(daily: DataFrame, target: str, k: int = 6, exclude: list[str] | tuple = ()) -> list[str]:
    """Top-k features by |correlation| with the target (the UI default), without those of
    ``exclude`` (``constants.LEAKS`` has the columns each target is computed from)."""
    cols = [c for c in mlprep.feature_columns(daily, target) if c not in exclude]
    top = mlprep.top_features(mlprep.target_correlation(daily, target, cols), k)
    return [r["feature"] for r in top.collect()]  # k rows


def split(daily: DataFrame, target: str, task: str, features: list[str], test_size: float = 0.2) -> DataFrame:
    """Seeded, reproducible split; stratified (exact per class) for classification."""
    data = daily.select(*[k for k in KEYS if k not in features], *[F.col(c).cast("double").alias(c) for c in features],
                        F.col(target).cast("double").alias("label"))
    order = [F.xxhash64(F.lit(SEED), *KEYS), *KEYS]
    if task == "classification":
        return mlprep.stratified_split(data, "label", test_size, order=order)
    ranked = positions(data, order, name="__pos")
    n = ranked.count()
    n_train = n - int(-(-n * test_size // 1))
    return ranked.withColumn("split", F.when(F.col("__pos") <= n_train, "train").otherwise("test")).drop("__pos")


def _prep_stages(features: list[str]):
    imp = [f"{c}__imp" for c in features]
    return [Imputer(inputCols=features, outputCols=imp, strategy="mean"),
            VectorAssembler(inputCols=imp, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def estimator(task: str, algorithm: str, n_features: int, n_train: int, **kw):
    if task == "classification":
        if algorithm == "logistic":
            c = kw.get("C", 1.0)
            return LogisticRegression(maxIter=1000, regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0)
        if algorithm == "randomforest":
            return RandomForestClassifier(numTrees=kw.get("numTrees", 100), maxDepth=kw.get("maxDepth", FOREST_DEPTH),
                                          minInstancesPerNode=FOREST_LEAF_ROWS, cacheNodeIds=True, seed=SEED)
        if algorithm == "xgboost":
            return GBTClassifier(maxIter=kw.get("maxIter", BOOST_ROUNDS), maxDepth=kw.get("maxDepth", 6),
                                 stepSize=kw.get("stepSize", 0.3), seed=SEED)
        if algorithm == "mlp":
            return MultilayerPerceptronClassifier(layers=[n_features, 128, 64, 2], maxIter=100, seed=SEED)
    else:
        if algorithm == "randomforest":
            return RandomForestRegressor(numTrees=kw.get("numTrees", 100), maxDepth=kw.get("maxDepth", FOREST_DEPTH),
                                         minInstancesPerNode=FOREST_LEAF_ROWS, cacheNodeIds=True, seed=SEED)
        if algorithm == "xgboost":
            return GBTRegressor(maxIter=kw.get("maxIter", BOOST_ROUNDS), maxDepth=kw.get("maxDepth", 6), stepSize=0.3, seed=SEED)
        if algorithm == "linear":
            return LinearRegression(regParam=0.0, solver="normal")
    raise ValueError(f"unsupported {task} algorithm: {algorithm}")


def _members(task: str, algorithm: str) -> list[tuple[str, dict]]:
    if algorithm != "ensemble":
        return [(algorithm, {})]
    if task == "classification":
        return [("logistic", {}), ("randomforest", {"numTrees": 50}), ("xgboost", {"maxIter": 50})]
    return [("linear", {}), ("randomforest", {}), ("xgboost", {})]


def _score_col(task: str):
    if task == "classification":
        return vector_to_array("probability")[1]
    return F.col("prediction")


def _prep(train: DataFrame, features: list[str]) -> PipelineModel:
    return Pipeline(stages=_prep_stages(features)).fit(train)


def _vectors(prep: PipelineModel, rows: DataFrame) -> DataFrame:
    """What an estimator reads of ``rows``, kept for the passes of its fits."""
    return prep.transform(rows).select("label", "features").persist()


class Prepared:
    """What all fits of a target share: its features, the stored split rows, the imputer and scaler
    fitted on the train rows, the vectors made with them, the folds, and the models fitted so far.

    Each is made once, by the first of the threads that ask for it.  An ensemble's member of the same
    settings as a model fitted alone is that model: same seed, same rows."""

    def __init__(self, target: str, features: list[str], rows: DataFrame):
        self.target, self.task, self.features, self.rows = target, K.TASKS[target], features, rows
        self.train, self.test = (rows.where(F.col("split") == part) for part in ("train", "test"))
        self._lock, self._made, self._kept = threading.Lock(), {}, []
        self._rounds = 0

    def once(self, key, make):
        with self._lock:
            first = key not in self._made
            made = self._made.setdefault(key, Future())
        if first:
            try:
                made.set_result(make())
            except BaseException as ex:
                made.set_exception(ex)
        return made.result()

    def keep(self, rows: DataFrame) -> DataFrame:
        """``rows``, whose stored blocks ``release`` frees."""
        self._kept.append(rows)
        return rows

    def release(self) -> None:
        for rows in self._kept:
            rows.unpersist()

    def expect(self, algorithm: str) -> None:
        """Says before any fit that ``algorithm`` will be fitted: boosted trees are then fitted once, with the most
        rounds any of them has, and those of fewer are cut from it."""
        self._rounds = max([self._rounds, *(kw.get("maxIter", BOOST_ROUNDS) for name, kw in _members(self.task, algorithm)
                                            if name == "xgboost")])

    def member(self, algorithm: str, kw: dict) -> PipelineModel:
        rounds = kw.get("maxIter", BOOST_ROUNDS)

        def make():
            if algorithm == "xgboost" and rounds < self._rounds:
                others = {k: v for k, v in kw.items() if k != "maxIter"}
                *prep, most = self.member(algorithm, others | ({} if self._rounds == BOOST_ROUNDS else {"maxIter": self._rounds})).stages
                return PipelineModel([*prep, first_rounds(most, rounds)])
            n_train = self.once("n_train", self.train.count)
            est = estimator(self.task, algorithm, len(self.features), n_train, **kw)
            prep = self.once("prep", lambda: _prep(self.train, self.features))
            if algorithm == "mlp":
                vectors = self.once("dealt vectors", lambda: self.keep(_vectors(prep, _more_tasks(self.train, n_train))))
            elif algorithm in TREES and n_train > FOLD_TASK_ROWS:
                vectors = self.once("tree vectors", lambda: self.keep(_vectors(prep, _tree_rows(self.train, n_train, self.features))))
            else:
                vectors = self.once("vectors", lambda: self.keep(_vectors(prep, self.train)))
            return PipelineModel([*prep.stages, est.fit(vectors)])
        return self.once((algorithm, *sorted(kw.items())), make)

    def folded(self, algorithm: str = "logistic") -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
        """(the train rows with their fold, the vectors to fit on and to judge by of each fold), in tasks
        that suit ``algorithm``."""
        n_train = self.once("n_train", self.train.count)
        layout = _tree_rows if algorithm in TREES and n_train > FOLD_TASK_ROWS else _one_task if algorithm == "xgboost" else _fewer_tasks

        def make():
            rows = self.once("folds", lambda: folds(self.train, "label" if self.task == "classification" else None, FOLDS,
                                                    [F.xxhash64(F.lit(SEED + 1), *KEYS), *KEYS]))
            rows = self.keep(layout(rows, n_train, self.features).persist())
            pairs = []
            for i in range(FOLDS):
                fitted, judged = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
                for part, name in ((fitted, "training"), (judged, "validation")):
                    if part.isEmpty():
                        raise ValueError(f"The {name} data at fold {i} is empty.")
                prep = _prep(fitted, self.features)
                pairs.append((self.keep(_vectors(prep, fitted)), self.keep(_vectors(prep, judged))))
            return rows, pairs
        return self.once(layout, make)


def _fewer_tasks(rows: DataFrame, n: int, features: list[str]) -> DataFrame:
    most = max(FOLD_TASKS, -(-n // FOLD_TASK_ROWS))
    return rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows


def _one_task(rows: DataFrame, n: int, features: list[str]) -> DataFrame:
    """The few rows of a boosted fit: its hundreds of jobs spend their time on starting tasks."""
    return rows.coalesce(1)


def _tree_rows(rows: DataFrame, n: int, features: list[str]) -> DataFrame:
    """The rows of a tree fit dealt evenly, those with like features next to each other: they pass the same
    nodes, whose statistics then stay in the processor's cache."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-n // FOLD_TASK_ROWS), cores * -(-n // (cores * TREE_TASK_ROWS)))
    order = F.xxhash64(*[k for k in KEYS if k in rows.columns]).alias("__order")
    read = rows.select(*[c for c in rows.columns if c not in KEYS or c in features], order)
    return read.repartition(tasks).sortWithinPartitions(*features, "__order")


def _more_tasks(rows: DataFrame, n: int) -> DataFrame:
    tasks = -(-n // MLP_TASK_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


def _to_score(rows: DataFrame, features: list[str], algorithms: list[str]) -> DataFrame:
    """Rows for trees to score, dealt and ordered as in ``_tree_rows``: the test rows of a ranked split lie in its last
    tasks."""
    if not {*TREES, "ensemble"} & {*algorithms}:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(*features)


def fit(prepared: Prepared, algorithm: str) -> list[PipelineModel]:
    return [prepared.member(name, kw) for name, kw in _members(prepared.task, algorithm)]


def _add_score(models: list[PipelineModel], df: DataFrame, task: str, name: str) -> DataFrame:
    """``df`` and the mean score of the member models: chained transforms on the same rows,
    one pass, no join."""
    out = df
    for i, m in enumerate(models):
        scored = m.transform(out)
        added = [c for c in scored.columns if c not in out.columns]
        out = scored.withColumn(f"__s{i}", _score_col(task)).drop(*added)
    parts = [f"__s{i}" for i in range(len(models))]
    return out.withColumn(name, sum(F.col(c) for c in parts) / len(models)).drop(*parts)


def predict(models: list[PipelineModel], df: DataFrame, task: str) -> DataFrame:
    """Soft vote (classification) / mean (regression) over the member models."""
    score = "probability" if task == "classification" else "prediction"
    out = _add_score(models, df, task, "__score").select(*KEYS, "label", F.col("__score").alias(score))
    if task == "classification":
        out = out.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    return out


def training_input(daily: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Keys, candidate features and target, checkpointed to the shared
    checkpoint folder: feature ranking, the split and every MLlib pass read
    it instead of re-deriving the daily summary from raw readings."""
    ensure_checkpoint_dir(daily.sparkSession)
    cols = list(features) if features else mlprep.feature_columns(daily, target)
    return daily.select(*KEYS, *[c for c in cols if c not in KEYS], target).checkpoint(eager=True)


def prepare(daily: DataFrame, target: str, features: list[str] | None = None,
            exclude: list[str] | tuple = (), store: bool = True) -> Prepared:
    """What all fits of a target share; the split rows are checkpointed, so that the passes of the
    fits don't rank them again.  Without ``store`` they are not: one grid search only ranks them into folds."""
    daily = training_input(daily, target, features)
    feats = features or default_features(daily, target, exclude=exclude)
    rows = split(daily, target, K.TASKS[target], feats)
    return Prepared(target, feats, rows.checkpoint(eager=True) if store else rows)


def train_and_predict(daily: DataFrame, target: str, algorithm: str, features: list[str] | None = None,
                      exclude: list[str] | tuple = (), prepared: Prepared | None = None):
    mine = prepared or prepare(daily, target, features, exclude)
    models = fit(mine, algorithm)
    if prepared is None:
        mine.release()
    return models, predict(models, _to_score(mine.test, mine.features, [algorithm]), mine.task), mine.features


def grid_search(daily: DataFrame, target: str = "tamper_detected", features: list[str] | None = None,
                algorithm: str = "logistic", parallelism: int = 4, grid: dict | None = None) -> DataFrame:
    """CrossValidator over three stratified folds; returns one row per grid point with its mean
    CV metric (accuracy for classifiers, R2 for regressors) and the winner."""
    rows, _, _, _ = tune_model(daily, target, features, algorithm, parallelism, grid)
    return daily.sparkSession.createDataFrame(
        rows, "target string, algorithm string, params string, cv_metric double, best boolean")


def has_grid(task: str, algorithm: str) -> bool:
    return (task, algorithm) in GRIDS


def folds(rows: DataFrame, label: str | None, n: int, order: list) -> DataFrame:
    """``rows`` with an int ``fold`` from 0: the position within the class (all rows without
    ``label``) modulo n, so that the folds of a class differ by at most one row; rows whose
    label is NULL are in none."""
    ranked = positions(rows, order, [label] if label else None, name="__pos")
    return ranked.withColumn("fold", ((F.col("__pos") - 1) % n).cast("int")).drop("__pos")


def _param_maps(est, grid: dict, n_train: int) -> tuple[list[dict], list[str]]:
    """The points of a grid as parameter maps of ``est``, and their names."""
    def setting(name, value):
        if name == "C":
            return est.regParam, 1.0 / (value * max(n_train, 1))
        if name == "n_estimators":
            return est.numTrees if est.hasParam("numTrees") else est.maxIter, value
        if name == "max_depth":
            return est.maxDepth, FOREST_DEPTH if value is None else value
        if name == "learning_rate":
            return est.stepSize, value
        raise ValueError(f"unknown grid parameter {name}")

    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return ([dict(setting(k, v) for k, v in p.items()) for p in points],
            [",".join(f"{k}={v}" for k, v in p.items()) for p in points])


def _fits(est, grid: list[dict]) -> list[list[int]]:
    """The points of a grid by the fits they need: points of boosted trees that differ in the number of rounds
    alone need one, of the most rounds, which comes last."""
    if not est.hasParam("stepSize"):
        return [[i] for i in range(len(grid))]
    alike: dict[tuple, list[int]] = {}
    for i, point in enumerate(grid):
        alike.setdefault(tuple(sorted((p.name, v) for p, v in point.items() if p != est.maxIter)), []).append(i)
    return [sorted(points, key=lambda i: grid[i].get(est.maxIter, est.getMaxIter())) for points in alike.values()]


def first_rounds(model, n: int):
    """The model of the first ``n`` rounds of a boosted fit: just what a fit of ``n`` rounds gives, as a round is fitted
    on those before it and its seed is its number's."""
    sc = SparkSession.active().sparkContext
    java, of = model._java_obj, sc._jvm.org.apache.spark.ml
    n = min(n, model.getNumTrees)
    trees = sc._gateway.new_array(of.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n], strict=True)):
        trees[i], weights[i] = tree, weight
    if isinstance(model, GBTClassificationModel):
        cut = GBTClassificationModel(of.classification.GBTClassificationModel(
            model.uid, trees, weights, model.numFeatures, model.numClasses))
    else:
        cut = GBTRegressionModel(of.regression.GBTRegressionModel(model.uid, trees, weights, model.numFeatures))
    return model._copyValues(cut, {model.maxIter: n})


def tune_model(daily: DataFrame, target: str, features: list[str] | None, algorithm: str, parallelism: int = 4,
               grid: dict | None = None, exclude: list[str] | tuple = (), prepared: Prepared | None = None):
    """Run the grid (``GRIDS`` unless given) over three folds; returns (grid rows, best model refitted on the train
    split, features, split rows).

    Imputer and scaler are fitted once a fold, on the rows its fits may see; all points share their vectors.
    ``parallelism`` fits run at a time."""
    task = K.TASKS[target]
    if not has_grid(task, algorithm):
        raise ValueError(f"no grid for {task}/{algorithm}")
    mine = prepared or prepare(daily, target, features, exclude, store=False)
    train, pairs = mine.folded(algorithm)
    n_train = mine.once("n_train", mine.train.count)
    est = estimator(task, algorithm, len(mine.features), n_train)
    grid, labels = _param_maps(est, grid or GRIDS[task, algorithm], n_train)
    evaluator = (MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification"
                 else RegressionEvaluator(metricName="r2"))

    def metrics_of(points, fold):
        fitted, judged = pairs[fold]
        model = est.fit(fitted, grid[points[-1]])
        models = [first_rounds(model, grid[i][est.maxIter]) for i in points[:-1]] + [model]
        return [evaluator.evaluate(m.transform(judged)) for m in models]

    with ThreadPoolExecutor(parallelism) as pool:
        run = inheritable_thread_target(daily.sparkSession)(metrics_of)
        found = [(points, [pool.submit(run, points, fold) for fold in range(FOLDS)]) for points in _fits(est, grid)]
        metrics = [0.0] * len(grid)
        for points, each in found:
            for i, of_folds in zip(points, zip(*(f.result() for f in each))):
                metrics[i] = sum(of_folds) / FOLDS
    best = max(range(len(metrics)), key=lambda i: metrics[i])
    rows = [(target, algorithm, labels[i], float(metrics[i]), i == best) for i in range(len(metrics))]

    def refit():
        prep = mine.once((train, "prep"), lambda: _prep(train, mine.features))
        vectors = mine.once((train, "vectors"), lambda: mine.keep(_vectors(prep, train)))
        return PipelineModel([*prep.stages, est.fit(vectors, grid[best])])

    model = refit()
    if prepared is None:
        mine.release()
    return rows, model, mine.features, mine.rows


# ---- metrics ------------------------------------------------------------------

def score_predictions(pred: DataFrame, task: str) -> float:
    if task == "classification":
        return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label",
                                             metricName="areaUnderROC").evaluate(
            pred.select(F.col("probability").cast("double"), F.col("label").cast("double")))
    return RegressionEvaluator(metricName="r2", labelCol="label", predictionCol="prediction").evaluate(pred)


def _metrics(pred: DataFrame, task: str, by: list[str]) -> DataFrame:
    """accuracy/precision/recall/f1 (weighted) or mae/mse/rmse/r2."""
    from gridlens.operators.evaluate import regression_metrics, weighted_metrics
    return weighted_metrics(pred, by=by) if task == "classification" else regression_metrics(pred, by=by)


def metrics_row(pred: DataFrame, target: str, task: str, model_file: str, category: str = "ml") -> DataFrame:
    return _metrics(pred, task, []).select(F.lit(target).alias("target"), F.lit(category.upper()).alias("model_type"),
                                           F.lit(model_file).alias("model_file"), F.lit(task).alias("task"), "*")


def evaluate_models(daily: DataFrame, models: list, sample: int | None = None) -> DataFrame:
    """Metrics of registered models (rows of the registry), one row each.

    The models of a target are evaluated together: one split, rows with a NULL feature or
    label dropped, at most ``sample`` of the rest (by hash) if asked for, one pass that adds every model's
    score, and one aggregate.  The loops are over targets and models."""
    tables = []
    for target in sorted({r["target"] for r in models}):
        task, mine = K.TASKS[target], [r for r in models if r["target"] == target]
        features = sorted({c for r in mine for c in r["features"]})
        rows = split(daily, target, task, features).where("split = 'test'").dropna(subset=[*features, "label"])
        if sample is not None:
            rows = mlprep.sample_rows(rows, sample, KEYS)
        rows = _to_score(rows, features, [r["algorithm"] for r in mine])
        for i, r in enumerate(mine):
            rows = _add_score(load_models(r["path"], r["members"]), rows, task, f"__m{i}")
        each = rows.select("label", F.explode(F.array(*[
            F.struct(F.lit(os.path.basename(r["path"])).alias("model_file"), F.lit(r["category"].upper()).alias("model_type"),
                     F.col(f"__m{i}").alias("score")) for i, r in enumerate(mine)])).alias("m")).select("label", "m.*")
        pred = (F.col("score") > 0.5).cast("int") if task == "classification" else F.col("score")
        by = ["model_type", "model_file"]
        tables.append(_metrics(each.withColumn("prediction", pred), task, by).select(
            F.lit(target).alias("target"), *by, F.lit(task).alias("task"), *METRICS[task]))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


#: the metrics of each task
METRICS = {"classification": ["accuracy", "precision", "recall", "f1_score"], "regression": ["mae", "mse", "rmse", "r2_score"]}
#: a metric in which all models of a task are equal
ALL_EQUAL = 0.5


def compare(metrics: DataFrame, task: str | None = None) -> DataFrame:
    """Models side by side: each metric min-max normalised over the models of its
    task, ``ALL_EQUAL`` where they don't differ, NULL for the other task's metrics.

    With ``task``, its models and metrics alone."""
    from pyspark.sql import Window
    if task is not None:
        metrics = metrics.where(F.col("task") == task)
    m = metrics.withColumn("display_name", F.concat_ws(" | ", "target", "model_type", "model_file")) \
        .dropDuplicates(["display_name"])
    w = Window.partitionBy("task")  # the metrics table has one row per model

    def scaled(c):
        least, most = F.min(c).over(w), F.max(c).over(w)
        return F.when((least == most) & F.col(c).isNotNull(), ALL_EQUAL).otherwise(F.try_divide(F.col(c) - least, most - least))

    columns = METRICS[task] if task is not None else [c for cs in METRICS.values() for c in cs]
    return m.select("display_name", "task", *[scaled(c).alias(c) for c in columns])


# ---- registry / logs (K1-K6) --------------------------------------------------

def store_dir(spark: SparkSession) -> str:
    """Models, registry and logs live under the shared checkpoint folder
    unless GRIDLENS_STORE names another shared location."""
    return os.environ.get("GRIDLENS_STORE") or os.path.join(ensure_checkpoint_dir(spark), "gridlens-store")


TRAIN_LOG = ("timestamp timestamp_ntz, target string, model_type string, algorithm string, status string, "
             "score double, error string")
REGISTRY = ("target string, algorithm string, category string, tuned boolean, run_ts timestamp_ntz, "
            "features array<string>, path string, members int")


def _append(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    if rows:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def _now() -> dt.datetime:
    return dt.datetime.now().replace(microsecond=0)


def log_training(spark: SparkSession, target: str, algorithm: str, model_type: str, status: str,
                 score: float | None, error: str | None, store: str | None = None) -> None:
    row = (_now(), target, model_type, algorithm, status, None if score is None else round(float(score), 4), error)
    _append(spark, [row], TRAIN_LOG, os.path.join(store or store_dir(spark), "train_log"))


def log_prediction(spark: SparkSession, model_used: str, num_predictions: int, input_source: str,
                   store: str | None = None) -> None:
    row = [(dt.datetime.now().replace(microsecond=0), model_used, int(num_predictions), input_source)]
    spark.createDataFrame(row, "timestamp timestamp_ntz, model_used string, num_predictions bigint, "
                               "input_source string") \
        .write.mode("append").parquet(os.path.join(store or store_dir(spark), "predict_log"))


def _train(daily: DataFrame, target: str, algorithm: str, category: str, tune: bool, features: list[str] | None,
           store: str, exclude: list[str] | tuple = (), prepared: Prepared | None = None, grids: dict | None = None):
    """load -> split -> fit -> score -> save; returns (log row, registry row or None, message).  Writes
    nothing but the model's own folder, so that several may run at once."""
    task = K.TASKS.get(target)
    tune = tune and has_grid(task, algorithm)  # others have no grid: trained and registered as default
    stamp = dt.datetime.now().strftime("%Y%m%d_%H%M%S_%f")
    name = f"{target}_{algorithm}_{category}_{'tuned' if tune else 'default'}_{stamp}"
    status, score, err, entry, message = "failed", None, None, None, None
    try:
        if category == "rl":
            raise NotImplementedError("reinforcement learning is not implemented")
        if task is None:
            raise ValueError(f"unknown target {target}")
        if category == "dl" and algorithm != "mlp":
            raise ValueError(f"unsupported dl algorithm {algorithm}")
        if category == "dl" and task != "classification":
            raise ValueError("mlp regression is not supported")
        if tune:
            grid = (grids or GRIDS).get((task, algorithm))
            _, best, feats, sp = tune_model(daily, target, features, algorithm, grid=grid, exclude=exclude, prepared=prepared)
            models = [best]
            pred = predict(models, _to_score(sp.where(F.col("split") == "test"), feats, [algorithm]), task)
        else:
            models, pred, feats = train_and_predict(daily, target, algorithm, features, exclude, prepared)
        score = round(float(score_predictions(pred, task)), 4)
        path = os.path.join(store, "models", name)
        for i, m in enumerate(models):
            m.write().overwrite().save(os.path.join(path, f"member_{i}"))
        entry = (target, algorithm, category, tune, _now(), feats, path, len(models))
        status, message = "completed", f"trained {name} score={score:.4f}"
    except NotImplementedError as ex:
        status, err, message = "skipped", str(ex), "Training skipped."
    except Exception as ex:  # noqa: BLE001 - reported as a failed run, like the reference
        err = message = str(ex)
    return (_now(), target, category.upper(), algorithm, status, score, err), entry, message


def _record(spark: SparkSession, store: str, outcomes: list[tuple]) -> None:
    """Registry and log rows of finished runs, one append each: appends to one folder must not
    overlap.  The registry comes first, so that a logged run can be loaded."""
    _append(spark, [entry for _, entry, _ in outcomes if entry], REGISTRY, os.path.join(store, "registry"))
    _append(spark, [row for row, _, _ in outcomes], TRAIN_LOG, os.path.join(store, "train_log"))


def train_pipeline(daily: DataFrame, target: str, algorithm: str, category: str = "ml", tune: bool = False,
                   features: list[str] | None = None, store: str | None = None,
                   exclude: list[str] | tuple = ()) -> tuple[bool, str]:
    """load -> split -> fit -> score -> save -> register -> log; returns (ok, message)."""
    store = store or store_dir(daily.sparkSession)
    outcome = _train(daily, target, algorithm, category, tune, features, store, exclude)
    _record(daily.sparkSession, store, [outcome])
    return outcome[0][4] == "completed", outcome[2]


def load_models(path: str, members: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/member_{i}") for i in range(members)]


def batch_score(models: list[PipelineModel], rows: DataFrame, task: str) -> DataFrame:
    """Score rows with saved models (scaler inside the model)."""
    return predict(models, rows, task)


def registry_latest(registry: DataFrame) -> DataFrame:
    """Latest registered model per (target, algorithm)."""
    from pyspark.sql import Window
    w = Window.partitionBy("target", "algorithm").orderBy(F.col("run_ts").desc(), F.col("path").desc())
    return registry.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def train_all(daily: DataFrame, kinds: list[tuple[str, str, str, bool]], store: str, grids: dict | None = None,
              parallelism: int = 4, exclude: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """Train the (target, algorithm, category, tuned) of ``kinds``, ``parallelism`` at a time, each in a scheduler
    pool of its own; those of a target share its preparation.  Registers and logs all at once; returns the status
    and message of each."""
    spark = daily.sparkSession
    shared = {t: prepare(daily, t, exclude=(exclude or {}).get(t, ())) for t in dict.fromkeys(k[0] for k in kinds)}
    for target, algorithm, category, tuned in kinds:
        if category == "ml" and not (tuned and has_grid(K.TASKS[target], algorithm)):
            shared[target].expect(algorithm)

    def run(target, algorithm, category, tuned):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{target}-{algorithm}")
        return _train(daily, target, algorithm, category, tuned, None, store, prepared=shared[target], grids=grids)

    with ThreadPoolExecutor(parallelism) as pool:
        fits = [pool.submit(inheritable_thread_target(spark)(run), *k) for k in kinds]
        outcomes = [f.result() for f in fits]
    for p in shared.values():
        p.release()
    _record(spark, store, outcomes)
    return [(row[4], message) for row, _, message in outcomes]


def train_sweep(daily: DataFrame, tasks: dict[str, str] | None = None, ml_algorithms: list[str] | None = None,
                dl_algorithms: list[str] | None = None, tune: bool = True, store: str | None = None,
                grids: dict | None = None, parallelism: int = 4, exclude: dict[str, list[str]] | None = None) -> DataFrame:
    """Task x algorithm sweep (H11): every target with every ML algorithm (tuned over ``grids``, by default
    ``GRIDS``) and the DL algorithm; pairs that do not apply to a task (e.g. logistic on a
    regression target) are logged as failed runs.

    The features and the split of a target are made once and stored; its fits share them.  ``parallelism``
    fits run at a time, each in a scheduler pool of its own (pools share the executors evenly where
    ``spark.scheduler.mode`` is FAIR).  Returns the training log rows of the store."""
    spark = daily.sparkSession
    store = store or store_dir(spark)
    ml_algorithms = ml_algorithms if ml_algorithms is not None else ["logistic", "randomforest", "xgboost", "ensemble"]
    dl_algorithms = dl_algorithms if dl_algorithms is not None else ["mlp"]
    kinds = [(t, *kind) for t in tasks or K.TASKS
             for kind in [(a, "ml", tune) for a in ml_algorithms] + [(a, "dl", False) for a in dl_algorithms]]
    train_all(daily, kinds, store, grids, parallelism, exclude)
    return spark.read.parquet(os.path.join(store, "train_log"))
