"""Training, selection, scoring and evaluation on ``pyspark.ml``."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import MLReader, MLWriter
from pyspark.sql import DataFrame, functions as F

from patronage.operators.grown_forest import GrownForest, fold_scores, grow_forest, importances, score_name
from patronage.operators.normal_map import NormalMap, NormalMapModel
from patronage.operators.selection import order_statistics, running_total, scalars
from patronage.session import materialize

# The searched settings. Unlimited depth becomes Spark's deepest
# tree (30); a minimum split size is no setting of Spark's, ``grow_forest`` takes it beside the others.
MIN_SPLIT = "minSplit"
CHURN_GRID = {"numTrees": [100, 200], "maxDepth": [5, 10, 30], "minInstancesPerNode": [1, 2], MIN_SPLIT: [2, 5]}
REVENUE_GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 30], "minInstancesPerNode": [1, 2], MIN_SPLIT: [2, 5]}
SEED = 42
TEST_SHARE = 0.2
FOLDS = 3


# --- split -----------------------------------------------------------------------


def split_rows(df: DataFrame, key: str = "customer_id", label: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``is_train``: exactly the 80 % lowest key hashes, within each class if given.

    The split depends on keys and seed only, never on partitions. A class of a
    single row cannot be stratified; then the split is plain.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    classes = [0, 1] if label else []
    if label:
        counts = scalars(hashed, **{f"c{c}": F.count_if(F.col(label) == c) for c in classes})
        if any(n == 1 for n in counts.values()):
            classes = []
    parts = {f"_h{c}": F.when(F.col(label) == c, F.col("_h")) for c in classes} or {"_h_all": F.col("_h")}
    cells = hashed.select(*[c.alias(n) for n, c in parts.items()])
    sizes = scalars(cells, **{n: F.count(n) for n in parts})
    cut = {n: size - math.ceil(size * TEST_SHARE) for n, size in sizes.items()}
    ranks = {n: [k - 1] for n, k in cut.items() if k > 0}
    edges = order_statistics(cells, ranks, sizes) if ranks else {}
    is_train = F.lit(False)
    for n, c in parts.items():
        if n in edges:
            is_train = is_train | F.coalesce(c <= F.lit(edges[n][cut[n] - 1]), F.lit(False))
    return hashed.withColumn("is_train", is_train).drop("_h")


def duplicate_lone_class(df: DataFrame, label: str = "churn_label") -> DataFrame:
    """Repeat the row of a class that has only one."""
    counts = scalars(df, **{f"c{c}": F.count_if(F.col(label) == c) for c in (0, 1)})
    for c in (0, 1):
        if counts[f"c{c}"] == 1:
            return df.unionByName(df.where(F.col(label) == c))
    return df


def fold_column(df: DataFrame, key: str, folds: int, seed: int = SEED) -> DataFrame:
    """Fold number from the key, so folds do not move with partitions."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(folds)).cast("int"))


def fit_rows(train: DataFrame, key: str, most: int, seed: int = SEED) -> DataFrame:
    """All rows, or about ``most`` of them by key hash. Training does not call it: it fits all its rows."""
    n = train.count()
    if n <= most:
        return train
    return train.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed + 2)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit_normal(train: DataFrame, names: list[str]) -> NormalMapModel:
    """The map of the features onto a normal scale, fitted on all training rows."""
    return NormalMap(inputCols=names, outputCol="mapped").fit(train)


# --- feature selection and search --------------------------------------------------


def select_features(df: DataFrame, names: list[str], forest, keep_all_if_none: bool, key: str = "customer_id") -> list[int]:
    """Positions of features at least as important as the average one."""
    shares = importances(df, forest, key)
    kept = [i for i, v in enumerate(shares) if v >= shares.mean()]
    return kept if kept or not keep_all_if_none else list(range(len(names)))


def grid(settings: dict[str, list]) -> list[dict]:
    """Every combination of the settings of the estimator."""
    grown = {k: v for k, v in settings.items() if k != MIN_SPLIT}
    return [dict(zip(grown, values)) for values in product(*grown.values())]


def search(estimator, evaluator, train: DataFrame, settings: dict, key: str, folds: int = FOLDS, parallelism: int = 8):
    """Best model of a cross-validated grid, and its settings; folds come from the key.

    The largest forest of each fold and leaf size scores the held-out rows for
    all settings, as it holds the smaller ones. Of equal settings the first wins.
    """
    settings = {"minInstancesPerNode": [1], MIN_SPLIT: [2]} | settings
    sizes, settings_ = settings[MIN_SPLIT], grid(settings)
    held = materialize(fold_scores(fold_column(train, key, folds), estimator, key, folds, settings), "fold-scores")
    regression = isinstance(evaluator, RegressionEvaluator)
    scored = evaluator.getPredictionCol() if regression else evaluator.getRawPredictionCol()

    def score(task) -> float:
        chosen, size, fold = task
        rows = held.where((F.col("leaf") == chosen["minInstancesPerNode"]) & (F.col("fold") == fold))
        value = F.col(score_name(chosen["numTrees"], chosen["maxDepth"], size))
        return evaluator.evaluate(rows.select(F.col("y").alias(evaluator.getLabelCol()), value.alias(scored)))

    tasks = [(chosen, size, fold) for chosen in settings_ for size in sizes for fold in range(folds)]
    pool, spark = ThreadPool(min(parallelism, len(tasks))), train.sparkSession
    try:
        scores = pool.map(inheritable_thread_target(spark)(score), tasks, chunksize=1)
    finally:
        pool.close()
    sign = 1 if evaluator.isLargerBetter() else -1
    means = [sum(sign * s for s in scores[i : i + folds]) / folds for i in range(0, len(tasks), folds)]
    chosen, size, _ = tasks[means.index(max(means)) * folds]
    forest = grow_forest(train, _with(estimator, chosen), key, min(sizes))  # grown and cut as it was judged
    return forest if size == min(sizes) else forest.cut_back(size), chosen | {MIN_SPLIT: size}


def _with(estimator, chosen: dict):
    return estimator.copy({estimator.getParam(k): v for k, v in chosen.items()})


@dataclass
class Fitted:
    """A trained model with what is needed to score any table of the same features.

    ``write().save(path)`` and ``Fitted.read().load(path)`` keep it in a folder;
    the tables it was trained and tested on are not part of it.
    """

    model: object
    names: list[str]
    kept: list[int]
    train: DataFrame | None = None
    test: DataFrame | None = None
    constant: float | None = None
    info: dict = field(default_factory=dict)
    normal: NormalMapModel | None = None

    @property
    def used(self) -> list[str]:
        return [self.names[i] for i in self.kept]

    def map(self, df: DataFrame) -> DataFrame:
        """Add ``mapped``: the features on the normal scale that the model was trained on."""
        return self.normal.transform(df) if self.normal else df.withColumn("mapped", F.col("features"))

    def cut(self, mapped: DataFrame) -> DataFrame:
        """``kept``, the mapped features that the model uses, in place of ``mapped``."""
        if len(self.kept) == len(self.names):
            return mapped.withColumnRenamed("mapped", "kept")
        return VectorSlicer(inputCol="mapped", outputCol="kept", indices=self.kept).transform(mapped).drop("mapped")

    def slice(self, df: DataFrame) -> DataFrame:
        return self.cut(self.map(df))

    def write(self) -> FittedWriter:
        return FittedWriter(self)

    @staticmethod
    def read() -> FittedReader:
        return FittedReader()


FORESTS = {c.__name__: c for c in (GrownForest, RandomForestClassificationModel, RandomForestRegressionModel)}


class FittedWriter(MLWriter):
    def __init__(self, fitted: Fitted):
        super().__init__()
        self.fitted = fitted

    def saveImpl(self, path: str) -> None:
        """A description, the map and the forest, each in a folder; the description comes last and marks the end."""
        f = self.fitted
        if f.normal is not None:
            f.normal.write().save(f"{path}/normal")
        if f.model is not None:
            f.model.write().save(f"{path}/forest")
        about = {
            "names": f.names, "kept": f.kept, "constant": f.constant, "info": f.info, "normal": f.normal is not None,
            "forest": type(f.model).__name__ if f.model is not None else None,
        }
        self.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


class FittedReader(MLReader):
    def load(self, path: str) -> Fitted:
        about = json.loads(self.sparkSession.read.text(f"{path}/about").first()["value"])
        forest, normal = about.pop("forest"), about.pop("normal")
        model = FORESTS[forest].load(f"{path}/forest") if forest else None
        return Fitted(model=model, normal=NormalMapModel.load(f"{path}/normal") if normal else None, **about)


def _forest(kind, label: str, trees: int, features: str = "features", depth: int = 30, **more):
    # sklearn-style defaults: grown out, and all features tried in a regression.
    strategy = "auto" if kind is RandomForestClassifier else "all"
    return kind(
        labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, seed=SEED,
        featureSubsetStrategy=strategy, maxBins=128, **more,
    )


def train_churn(
    df: DataFrame, names: list[str], label: str = "churn_label", key: str = "customer_id",
    settings: dict | None = CHURN_GRID, selector_trees: int = 100, selector_depth: int = 30, folds: int = FOLDS,
) -> Fitted:
    """Forest on 80 % of the rows, all of which are fitted, after feature selection and a grid search.

    One class only: nothing can be learned, that class is predicted and the
    churn score is 0 everywhere. ``settings=None`` skips the search and grows
    the default forest.
    """
    everything = list(range(len(names)))
    classes = scalars(df, n0=F.count_if(F.col(label) == 0), n1=F.count_if(F.col(label) == 1))
    if not (classes["n0"] and classes["n1"]):
        return Fitted(None, names, everything, df, df, constant=1.0 if classes["n1"] else 0.0)
    work = split_rows(duplicate_lone_class(df, label), key, label).persist()
    train, test = work.where("is_train"), work.where("not is_train")
    try:
        selector = _forest(RandomForestClassifier, label, selector_trees, "mapped", selector_depth)
        fitted = Fitted(None, names, everything, train, test, normal=fit_normal(train, names))
        fitting = fitted.map(train).persist()
        fitted.kept = select_features(fitting, names, selector, False, key)
        sliced = fitted.cut(fitting)
        forest = _forest(RandomForestClassifier, label, 100, "kept", depth=selector_depth)
        if settings:
            auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", metricName="areaUnderROC")
            fitted.model, fitted.info["settings"] = search(forest, auc, sliced, settings, key, folds)
        else:
            fitted.model = grow_forest(sliced, forest, key)
        fitting.unpersist()
    finally:
        work.unpersist()
    return fitted


def train_revenue(
    df: DataFrame, names: list[str], label: str = "target_revenue", key: str = "customer_id",
    settings: dict | None = REVENUE_GRID, selector_trees: int = 100, selector_depth: int = 30, folds: int = FOLDS,
) -> Fitted:
    """Regression forest on 80 % of the rows, all of which are fitted; below five rows a forest of ten on all rows, without a split."""
    n = df.count()
    everything = list(range(len(names)))
    if n < 5:
        small = Fitted(None, names, everything, df, df)
        small.model = _forest(RandomForestRegressor, label, 10, "kept").fit(small.slice(df))
        return small
    work = split_rows(df, key).persist()
    train, test = work.where("is_train"), work.where("not is_train")
    try:
        selector = _forest(RandomForestRegressor, label, selector_trees, "mapped", selector_depth)
        fitted = Fitted(None, names, everything, train, test, normal=fit_normal(train, names))
        fitting = fitted.map(train).persist()
        fitted.kept = select_features(fitting, names, selector, True, key)
        sliced = fitted.cut(fitting)
        rows = n - math.ceil(n * TEST_SHARE)
        if settings and rows >= 5:
            forest = _forest(RandomForestRegressor, label, 100, "kept", depth=selector_depth)
            mse = RegressionEvaluator(labelCol=label, metricName="mse")
            fitted.model, fitted.info["settings"] = search(forest, mse, sliced, settings, key, min(folds, rows))
        else:
            fitted.model = grow_forest(sliced, _forest(RandomForestRegressor, label, 50, "kept", depth=selector_depth), key)
        fitting.unpersist()
    finally:
        work.unpersist()
    return fitted


# --- scoring ------------------------------------------------------------------------


def score_churn(fitted: Fitted, df: DataFrame, out: str = "churn_probability_final") -> DataFrame:
    """Probability of the churn class for every row, within 0..1."""
    if fitted.model is None:
        return df.withColumns({out: F.lit(0.0), "prediction": F.lit(fitted.constant)})
    scored = fitted.model.transform(fitted.slice(df))
    p = F.coalesce(vector_to_array("probability")[1], F.lit(0.0))
    scored = scored.withColumn(out, F.least(F.greatest(F.nanvl(p, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return scored.drop("kept", "rawPrediction", "probability")


def score_revenue(fitted: Fitted, df: DataFrame, out: str = "predicted_revenue") -> DataFrame:
    """Predicted revenue for every row, never below 0."""
    scored = fitted.model.transform(fitted.slice(df))
    return scored.withColumn(out, F.greatest(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0))).drop("kept", "prediction")


# --- evaluation ----------------------------------------------------------------------


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision and recall; a metric without a denominator is 0."""
    hit = (F.col(predicted) == 1) & (F.col(truth) == 1)
    counts = df.agg(
        F.count_if(hit).alias("tp"),
        F.count_if((F.col(predicted) == 1) & (F.col(truth) == 0)).alias("fp"),
        F.count_if((F.col(predicted) == 0) & (F.col(truth) == 1)).alias("fn"),
        F.count_if(F.col(predicted) == F.col(truth)).alias("agree"),
        F.count(F.lit(1)).alias("n"),
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return counts.select(
        ratio(F.col("agree"), F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sum with mid-ranks; null for one class.

    Rows collapse to one per distinct score first; the running count over
    scores is computed range by range.
    """
    cells = (
        df.select(F.col(score).cast("double").alias("s"), F.col(truth).cast("long").alias("y"))
        .where("s is not null and y is not null")
        .groupBy("s")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    ranked = running_total(cells, "s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """R squared, mean squared and mean absolute error in one pass."""
    y, e = F.col(truth), F.col(truth) - F.col(predicted)
    s = df.agg(
        F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), F.count(e).alias("n"), F.var_pop(y).alias("var"),
    )
    sst = F.col("var") * F.col("n")
    # A constant truth has no variance: a perfect fit scores 1, anything else 0.
    r2 = F.when(sst > 0, 1 - F.col("sse") / sst).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return s.select(r2.alias("r2_score"), (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"))


def model_run(df: DataFrame, model_type: str, used: list[str], metrics: dict) -> DataFrame:
    """One row that describes a training run."""
    row = [(model_type, used, json.dumps(metrics, sort_keys=True), metrics.get("accuracy"), metrics.get("r2_score"))]
    return df.sparkSession.createDataFrame(
        row, "model_type string, features_used array<string>, metrics string, accuracy double, r2_score double"
    )


def evaluate_churn(fitted: Fitted, label: str = "churn_label") -> dict:
    """Metrics on the test rows (on all rows when there was no split), which the model keeps; a loaded model has those it kept."""
    if fitted.test is not None:
        scored = materialize(score_churn(fitted, fitted.test).select(label, "prediction", "churn_probability_final"), "churn-test")
        out = class_metrics(scored, label, "prediction").first().asDict()
        out.update(roc_auc(scored, label, "churn_probability_final").first().asDict())
        fitted.info["metrics"] = out
    return fitted.info["metrics"]


def evaluate_revenue(fitted: Fitted, label: str = "target_revenue") -> dict:
    if fitted.test is not None:
        scored = score_revenue(fitted, fitted.test)
        fitted.info["metrics"] = regression_metrics(scored, label, "predicted_revenue").first().asDict()
    return fitted.info["metrics"]
