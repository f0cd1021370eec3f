import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import grown_forest as g
from patronage.operators import models as m
from patronage.operators.features import feature_matrix
from tests.conftest import values

SETTINGS = {"numTrees": [2, 30], "maxDepth": [2, 6, 30], "minInstancesPerNode": [1, 3], "minSplit": [2, 9]}


def noisy(frame, n=200, parts=3):
    rng = np.random.default_rng(5)
    xs = rng.random((n, 3)).round(2)
    ys = xs[:, 0] + 0.4 * xs[:, 1] + 0.5 * rng.random(n)
    rows = [(i, *map(float, x), float(y), int(y > 0.9)) for i, (x, y) in enumerate(zip(xs, ys))]
    return feature_matrix(frame(rows, "customer_id long, a double, b double, c double, target_revenue double, churn_label int", parts), ["a", "b", "c"])


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_the_depth(spark, frame):
    df, names = noisy(frame, 400)
    shallow, deep = (
        jobs_of(spark, f"depth-{d}", lambda: m.train_revenue(df, names, settings=None, selector_trees=3, selector_depth=d)) for d in (2, 30)
    )
    assert shallow == deep


def best_split(x, y, w, leaf):
    """Greatest fall of the summed squares by any threshold, feature by feature and value by value."""
    def squares(at):
        mean = np.average(y[at], weights=w[at])
        return (w[at] * (y[at] - mean) ** 2).sum()

    best = (0.0, None, None)
    for f in range(len(x)):
        for v in np.unique(x[f])[:-1]:
            left = x[f] <= v
            if min(w[left].sum(), w[~left].sum()) >= leaf:
                fall = squares(np.ones(len(y), bool)) - squares(left) - squares(~left)
                if fall > best[0] + 1e-9:
                    best = (fall, f, left)
    return best


@pytest.mark.parametrize("leaf, least", [(1, 2), (3, 2), (1, 12)])
def test_every_split_is_the_best_one(leaf, least):
    rng = np.random.default_rng(leaf + least)
    x, w = rng.random((3, 80)).round(1), rng.poisson(1.0, 80)
    y = x[0] + rng.random(80)
    cuts = [g.cut_points(v, 128) for v in x]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x)])
    tree = g.grow_tree(bins, cuts, y, w, 30, leaf, least, 3, rng)

    def check(node, at):
        assert tree["rows"][node] == w[at].sum()
        assert tree["value"][node] == pytest.approx(np.average(y[at], weights=w[at]))
        fall, _, _ = best_split(x[:, at], y[at], w[at], leaf)
        if tree["child"][node] < 0:
            assert fall < 1e-9 or w[at].sum() < least
            return 1
        assert w[at].sum() >= least and tree["gain"][node] * w[at].sum() == pytest.approx(fall)
        right = at & (x[tree["feature"][node]] > tree["threshold"][node])
        return 1 + check(tree["child"][node], at & ~right) + check(tree["child"][node] + 1, right)

    assert check(0, w > 0) == len(tree["child"])


def same_tree(a, b):
    """Equal nodes along equal paths, however they are numbered."""
    def nodes(tree, i=0):
        here = (tree["feature"][i], tree["threshold"][i], tree["rows"][i], round(float(tree["value"][i]), 9))
        return [here] if tree["child"][i] < 0 else [here, *nodes(tree, tree["child"][i]), *nodes(tree, tree["child"][i] + 1)]

    return nodes(a) == nodes(b) and a["importance"] == pytest.approx(b["importance"])


@pytest.mark.parametrize("classes", [False, True])
def test_rows_of_a_cell_grow_the_tree_of_single_rows(classes):
    rng = np.random.default_rng(8)
    x = rng.random((4, 600)).round(1)
    y = (x[0] + x[1] * rng.random(600)).round(3)
    y = (y > 0.8).astype(float) if classes else y
    cuts = [g.cut_points(v, 128) for v in x[:4 if classes else 2]]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x)]).astype(np.int8)
    assert len(g.cells_of(bins)[1]) < 600
    tree = next(g.Rules(42, 128, classes, 30, 1).trees(bins, cuts, y, range(7, 8)))
    draw_from = np.random.default_rng([42, 7])
    draw, middle = draw_from.poisson(1.0, 600), 0.0 if classes else y.mean()
    single = g.grow_tree(bins, cuts, y - middle, draw, 30, 1, 2, 2, draw_from)
    assert same_tree(tree, single | {"value": single["value"] + middle})


@pytest.mark.parametrize("depth, leaf, least", [(30, 1, 2), (4, 3, 20)])
def test_a_tree_of_many_blocks_is_the_tree_of_one(monkeypatch, depth, leaf, least):
    rng = np.random.default_rng(9)
    x, w = rng.random((3, 500)).round(2), rng.poisson(1.0, 500)
    y = (100 * (x[0] * 3 + x[1] + rng.random(500))).round()  # sums are exact, so equal splits stay equal
    cuts = [g.cut_points(v, 128) for v in x]
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x)])
    whole = g.grow_tree(bins, cuts, y, w, depth, leaf, least, 3, rng)
    monkeypatch.setattr(g, "BLOCK", 40)
    parts = g.grow_tree(bins, cuts, y, w, depth, leaf, least, 3, rng)
    assert len(whole["child"]) == len(parts["child"]) and same_tree(whole, parts)
    values_ = g.walk(whole, x, [2, depth]), g.walk(parts, x, [2, depth])
    assert np.allclose(values_[0], values_[1])


def test_cells_of_many_bins_are_told_apart():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 128, (12, 300)).astype(np.int8)
    bins = np.concatenate([bins, bins[:, :100]], 1)
    order, starts = g.cells_of(bins)
    assert sorted(order) == list(range(400)) and len(starts) == 300
    for rows in np.split(order, starts[1:]):
        assert (bins[:, rows] == bins[:, rows[:1]]).all() and list(rows) == sorted(rows)


def test_a_forest_without_stated_thresholds_scores_alike(frame):
    df, _ = noisy(frame)
    forest = g.grow_forest(df, m._forest(m.RandomForestRegressor, "target_revenue", 5), "customer_id")
    old = g.GrownForest(forest.path, {k: v for k, v in forest.about.items() if k != "cuts"})
    assert values(old.transform(df), "customer_id", "prediction") == values(forest.transform(df), "customer_id", "prediction")


def test_thresholds_of_many_values_take_equal_shares():
    cuts = g.cut_points(np.r_[np.arange(1000.0), np.full(5000, 7.0)], 10)
    assert len(cuts) <= 9 and list(cuts) == sorted(set(cuts))
    counts = np.bincount(np.searchsorted(g.cut_points(np.arange(1000.0), 10), np.arange(1000.0)))
    assert len(counts) == 10 and counts.min() >= 99 and counts.max() <= 101


@pytest.mark.parametrize("kind, label", [(m.RandomForestRegressor, "target_revenue"), (m.RandomForestClassifier, "churn_label")])
def test_one_forest_judges_the_whole_grid_as_single_ones_do(spark, frame, kind, label):
    df, _ = noisy(frame)
    folded = m.fold_column(df, "customer_id", 2)
    scores = g.fold_scores(folded, m._forest(kind, label, 30), "customer_id", 2, SETTINGS).persist()
    for trees, depth, leaf, size, fold in [(2, 2, 1, 2, 0), (30, 6, 3, 9, 1), (30, 30, 1, 9, 0), (2, 30, 3, 2, 1)]:
        forest = g.grow_forest(folded.where(F.col("_fold") != fold), m._forest(kind, label, trees, depth=depth, minInstancesPerNode=leaf), "customer_id")
        forest = forest if size == 2 else forest.cut_back(size)
        out = forest.transform(folded.where(F.col("_fold") == fold))
        value = F.col("prediction") if kind is m.RandomForestRegressor else m.vector_to_array("probability")[1]
        want = sorted(r[0] for r in out.select(value).collect())
        got = scores.where((F.col("leaf") == leaf) & (F.col("fold") == fold)).select(g.score_name(trees, depth, size))
        assert sorted(r[0] for r in got.collect()) == pytest.approx(want, abs=1e-12)
        assert forest.trees().count() == trees


def test_forests_do_not_depend_on_partitions_and_score_no_rows(frame):
    one, many = (noisy(frame, parts=p)[0] for p in (1, 9))
    forests = [g.grow_forest(df, m._forest(m.RandomForestClassifier, "churn_label", 4), "customer_id") for df in (one, many)]
    a, b = (values(f.transform(df), "customer_id", "prediction", "probability") for f, df in zip(forests, (many, one)))
    assert a == b and len(a) == 200
    assert forests[0].transform(one.limit(0)).collect() == []


def test_rows_are_scored_in_parts(frame, monkeypatch):
    df, _ = noisy(frame, parts=5)
    forest = g.grow_forest(df, m._forest(m.RandomForestRegressor, "target_revenue", 40), "customer_id")
    whole = values(forest.transform(df), "customer_id", "prediction")
    monkeypatch.setattr(g, "GROUP", 60)
    assert values(forest.transform(df), "customer_id", "prediction") == whole


def test_the_important_feature_is_found(frame):
    df, _ = noisy(frame)
    shares = g.importances(df, m._forest(m.RandomForestRegressor, "target_revenue", 5), "customer_id")
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0


def test_no_forest_of_the_churn_search_is_held_by_the_driver(spark, frame):
    df, names = noisy(frame, 400)
    quick = {"settings": {"numTrees": [3], "maxDepth": [3], "minInstancesPerNode": [1], "minSplit": [2, 5]}, "selector_trees": 3, "folds": 2}
    kept = {}
    shallow, deep = (jobs_of(spark, f"churn-{d}", lambda: kept.update({d: m.train_churn(df, names, selector_depth=d, **quick)})) for d in (2, 30))
    assert shallow == deep and isinstance(kept[30].model, g.GrownForest)
    nodes = kept[30].model.cut_back(5).nodes()
    assert nodes.where("leftChild >= 0 and rawCount < 5").isEmpty()
    ends = nodes.select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id")).where("id >= 0")
    assert nodes.where("id > 0").select("treeID", "id").exceptAll(ends).isEmpty()  # each node but the root is the child of one
