import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from patronage.operators import models as m
from patronage.operators.cut_trees import cut_back
from patronage.operators.features import feature_matrix
from patronage.plans import analysis
from tests.conftest import values

QUICK = {"settings": {"numTrees": [5], "maxDepth": [3], "minInstancesPerNode": [1, 2], "minSplit": [2, 5]}, "selector_trees": 5, "selector_depth": 3, "folds": 2}


def labelled(frame, n=200, parts=3, positives=60):
    rows = [(i, int(i < positives)) for i in range(n)]
    return frame(rows, "customer_id long, churn_label int", parts)


def test_split_is_stratified_exact_and_stable(frame):
    a = m.split_rows(labelled(frame, parts=1), label="churn_label")
    b = m.split_rows(labelled(frame, parts=8), label="churn_label")
    assert values(a, "customer_id", "is_train") == values(b, "customer_id", "is_train")
    assert values(a.groupBy("churn_label", "is_train").count(), "churn_label", "is_train", "count") == [
        (0, False, 28), (0, True, 112), (1, False, 12), (1, True, 48)]
    plain = m.split_rows(labelled(frame, 51))
    assert plain.where("is_train").count() == 40
    lone = m.split_rows(labelled(frame, 50, positives=1), label="churn_label")
    assert lone.where("is_train").count() == 40


def test_lone_class_is_duplicated(frame):
    out = m.duplicate_lone_class(labelled(frame, 20, positives=1))
    assert out.count() == 21 and out.where("churn_label = 1").count() == 2
    assert m.duplicate_lone_class(labelled(frame, 20, positives=2)).count() == 20


def test_metrics(frame):
    rng = np.random.default_rng(1)
    rows = [(int(y), float(round(min(1, max(0, 0.3 * y + rng.random() * 0.7)), 1))) for y in rng.integers(0, 2, 300)]
    df = frame(rows, "y int, s double")
    got = m.roc_auc(df, "y", "s").first()["roc_auc"]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert got == pytest.approx(want, abs=1e-12)
    peer = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="s", numBins=0).evaluate(df.withColumn("y", F.col("y").cast("double")))
    assert got == pytest.approx(peer, abs=1e-6)
    assert m.roc_auc(df.where("y = 1"), "y", "s").first()["roc_auc"] is None
    none = m.class_metrics(frame([(1, 0), (0, 0)], "y int, p int"), "y", "p").first().asDict()
    assert none == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0}
    r = m.regression_metrics(frame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double"), "y", "p").first()
    assert r["mse"] == pytest.approx(1.25 / 3) and r["mae"] == pytest.approx(0.5) and r["r2_score"] == pytest.approx(1 - 1.25 / (14 / 3))
    flat = m.regression_metrics(frame([(1.0, 1.0), (1.0, 1.0)], "y double, p double"), "y", "p").first()
    assert flat["r2_score"] == 1.0


def rolled(frame, n=120):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(10, 9000)), int(rng.integers(1, 40)), int(rng.integers(0, 400))) for i in range(n)]
    return frame(rows, "customer_id long, total_amount double, transaction_count long, days_since_last_purchase long")


def test_churn_analysis(frame):
    out, info = analysis.analyze_churn(rolled(frame), "2024-01-31", **QUICK)
    rows = values(out, "customer_id", "churn_label", "churn_probability_final", "risk_level")
    assert len(rows) == 120 and {r[1] for r in rows} == {0, 1}
    assert all(0 <= r[2] <= 1 for r in rows)
    i = info.first()
    assert i["model_type"] and i["features_used"] and 0 <= i["accuracy"] <= 1


def test_revenue_analysis(frame):
    out, info = analysis.analyze_revenue(rolled(frame), "2024-01-31", **QUICK)
    rows = values(out, "predicted_revenue", "revenue_segment", "total_revenue", "transaction_count", "avg_transaction_value")
    assert len(rows) == 120 and all(r[0] >= 0 for r in rows)
    assert {r[1] for r in rows} <= {"High Value", "Medium Value", "Low Value"}
    assert info.first()["r2_score"] is not None


def test_degenerate_revenue(frame):
    flat = frame([(i, 5.0, 3, i) for i in range(10)], "customer_id long, total_amount double, transaction_count long, days_since_last_purchase long")
    out, _ = analysis.analyze_revenue(flat, "2024-01-31", **QUICK)
    assert {tuple(r) for r in out.select("predicted_revenue", "revenue_segment").collect()} == {(0.0, "Medium Value")}
    bare, _ = analysis.analyze_revenue(frame([(1,), (2,)], "customer_id long"), "2024-01-31", on_missing="neutral", **QUICK)
    assert {r["revenue_segment"] for r in bare.collect()} == {"Medium Value"}


def test_single_class_scores_zero(frame):
    df = frame([(i, 0, float(i)) for i in range(10)], "customer_id long, churn_label int, x double")
    table, names = feature_matrix(df, ["x"])
    fitted = m.train_churn(table, names, **QUICK)
    assert {r[0] for r in m.score_churn(fitted, table).select("churn_probability_final").collect()} == {0.0}
    assert m.evaluate_churn(fitted)["roc_auc"] is None
    ones = table.withColumn("churn_label", F.lit(1))
    fitted = m.train_churn(ones, names, **QUICK)
    assert {tuple(r) for r in m.score_churn(fitted, ones).select("prediction", "churn_probability_final").collect()} == {(1.0, 0.0)}
    assert m.evaluate_churn(fitted)["accuracy"] == 1.0


def test_fit_rows_are_bounded_by_key(frame):
    df = frame([(i,) for i in range(5000)], "customer_id long")
    few = m.fit_rows(df, "customer_id", 500)
    assert 400 < few.count() < 600 and values(few) == values(m.fit_rows(df.repartition(9), "customer_id", 500))
    assert m.fit_rows(df, "customer_id", 5000).count() == 5000


def many(spark, n=280_000):
    noise = lambda k, most: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most)).cast("double")
    df = spark.range(n).select(F.col("id").alias("customer_id"), noise(1, 40).alias("a"), noise(2, 30).alias("b"), noise(3, 9).alias("c"))
    df = df.withColumns({"target_revenue": F.expr("a + b * c"), "churn_label": F.expr("int(a + b + c > 40)")})
    return feature_matrix(df, ["a", "b"])


def rows_of_trees(fitted):
    """Mean of the rows that the trees of a forest were grown over, as their bootstraps drew them."""
    return fitted.model.nodes().where("id = 0").agg(F.avg("rawCount")).first()[0]


def test_the_churn_forest_is_grown_over_all_training_rows(spark):
    df, names = many(spark)
    fitted = m.train_churn(df, names, settings=None, selector_trees=2, selector_depth=3)
    n = fitted.train.count()
    assert n > 220_000 and rows_of_trees(fitted) == pytest.approx(n, rel=0.005)


def test_the_revenue_forest_is_grown_over_all_training_rows(spark):
    df, names = many(spark)
    fitted = m.train_revenue(df, names, settings=None, selector_trees=2, selector_depth=3)
    assert fitted.train.count() == 224_000 and rows_of_trees(fitted) == pytest.approx(224_000, rel=0.005)


def test_analysis_numbers_rows_without_ids(frame):
    df = rolled(frame, 30).drop("customer_id")
    out, _ = analysis.analyze_churn(df, "2024-01-31", order_by=[F.col("total_amount"), F.col("days_since_last_purchase")], **QUICK)
    assert values(out, "customer_id") == sorted([(i,) for i in range(1, 31)], key=repr)


def test_plain_auc_compares_no_pairs_of_scores(frame):
    import random

    from patronage.queries.models import rank_auc

    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 3)) for _ in range(800)]
    out = rank_auc(frame(rows, "y int, p double"))
    wins = sum((a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z)
    pos = sum(y for y, _ in rows)
    assert out.first()["auc"] == pytest.approx(wins / (pos * (len(rows) - pos)), abs=1e-12)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def forest_table(frame, n=150):
    rng = np.random.default_rng(4)
    xs = rng.random((n, 3))
    rows = [(i, *map(float, x), float(x[0] + 0.4 * x[1] + 0.3 * rng.random()), int(x[0] + 0.4 * x[1] + 0.3 * rng.random() > 0.8)) for i, x in enumerate(xs)]
    df = frame(rows, "customer_id long, a double, b double, c double, target_revenue double, churn_label int")
    return feature_matrix(df, ["a", "b", "c"])


def walk(nodes, x, least):
    """The node at which a walk down a stored tree ends if smaller nodes are not split."""
    i = 0
    while nodes[i].leftChild >= 0 and nodes[i].rawCount >= least:
        split = nodes[i].split
        i = nodes[i].leftChild if x[split.featureIndex] <= split.leftCategoriesOrThreshold[0] else nodes[i].rightChild
    return nodes[i]


@pytest.mark.parametrize("least", [2, 5, 40, 10**6])
def test_cut_forests_stop_at_small_nodes(spark, frame, tmp_path, least):
    df, _ = forest_table(frame)
    for kind, label in ((m.RandomForestClassifier, "churn_label"), (m.RandomForestRegressor, "target_revenue")):
        grown = m._forest(kind, label, 4, depth=8).fit(df)
        path = f"{tmp_path}/{label}"
        grown.write().save(path)
        trees = {}
        for r in spark.read.parquet(f"{path}/data").orderBy("treeID", "nodeData.id").collect():
            trees.setdefault(r.treeID, []).append(r.nodeData)
        cut = cut_back(grown, least)
        assert (cut is grown) == (least == 2) and (least < 10**6 or cut.totalNumNodes == 4)
        for r in cut.transform(df).collect():
            ends = [walk(nodes, r.features, least) for nodes in trees.values()]
            if label == "churn_label":
                want = np.mean([np.array(e.impurityStats) / sum(e.impurityStats) for e in ends], axis=0)
                assert r.probability.toArray() == pytest.approx(want, abs=1e-12)
            else:
                assert r.prediction == pytest.approx(np.mean([e.prediction for e in ends]), abs=1e-12)


def test_the_grids_are_whole():
    assert [len(m.grid(g)) * len(g[m.MIN_SPLIT]) for g in (m.CHURN_GRID, m.REVENUE_GRID)] == [24, 36]


def test_search_takes_the_best_mean_over_the_folds(frame):
    df, _ = forest_table(frame)
    settings = {"numTrees": [3], "maxDepth": [2, 6], "minInstancesPerNode": [1], "minSplit": [2, 30]}
    forest = m._forest(m.RandomForestRegressor, "target_revenue", 3)
    mse = RegressionEvaluator(labelCol="target_revenue", metricName="mse")
    model, chosen = m.search(forest, mse, df, settings, "customer_id", 3)
    folded = m.fold_column(df, "customer_id", 3)
    means = {}
    for depth in (2, 6):
        for size in (2, 30):
            errors = []
            for fold in range(3):
                one = m._with(forest, {"maxDepth": depth}).fit(folded.where(F.col("_fold") != fold))
                errors.append(mse.evaluate(cut_back(one, size).transform(folded.where(F.col("_fold") == fold))))
            means[depth, size] = np.mean(errors)
    assert (chosen["maxDepth"], chosen["minSplit"]) == min(means, key=means.get)
    assert model.getNumTrees == 3


@pytest.mark.parametrize("label", ["churn_label", "target_revenue"])
def test_a_saved_model_scores_the_same_rows(spark, frame, tmp_path, label):
    df, names = forest_table(frame)
    train, score, out = (m.train_churn, m.score_churn, "churn_probability_final") if label == "churn_label" else (m.train_revenue, m.score_revenue, "predicted_revenue")
    fitted = train(df, names, **QUICK)
    fitted.write().save(f"{tmp_path}/m")
    loaded = m.Fitted.read().load(f"{tmp_path}/m")
    assert (loaded.names, loaded.kept, loaded.used, loaded.info) == (fitted.names, fitted.kept, fitted.used, fitted.info)
    assert set(loaded.info["settings"]) == {"numTrees", "maxDepth", "minInstancesPerNode", "minSplit"}
    assert values(score(loaded, df), "customer_id", out) == values(score(fitted, df), "customer_id", out)
    with pytest.raises(Exception, match="already exists"):
        fitted.write().save(f"{tmp_path}/m")
    fitted.write().overwrite().save(f"{tmp_path}/m")


def test_models_without_a_forest_are_kept_too(frame, tmp_path):
    df, names = forest_table(frame, 20)
    fitted = m.train_churn(df.withColumn("churn_label", F.lit(1)), names, **QUICK)
    fitted.write().save(f"{tmp_path}/m")
    loaded = m.Fitted.read().load(f"{tmp_path}/m")
    assert (loaded.model, loaded.normal, loaded.constant) == (None, None, 1.0)
    assert {r.prediction for r in m.score_churn(loaded, df).collect()} == {1.0}


def test_training_sees_the_normal_scale(frame):
    df, names = forest_table(frame)
    fitted = m.train_revenue(df, names, **QUICK)
    train = fitted.train.orderBy("a").collect()
    marks = fitted.normal.marks["a"]
    assert len(marks) == len(train) == 120 and marks == [r.a for r in train]  # all training rows, and no others
    assert fitted.slice(df).first()["kept"].size == len(fitted.kept)
