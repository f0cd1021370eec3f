import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from patronage.operators import quantiles as q
from patronage.operators.normal_map import NormalMap, NormalMapModel, quantile_marks
from patronage.operators.selection import extreme_rows, order_statistics, quantiles, running_total, with_row_index
from tests.conftest import values


def column(frame, xs, t="double"):
    as_python = {"double": float, "long": int}[t]
    return frame([(i, None if x is None else as_python(x)) for i, x in enumerate(xs)], f"id long, x {t}")


SHAPES = {
    "distinct": list(np.random.default_rng(1).normal(size=400)),
    "hot value": [5.0] * 150 + list(np.random.default_rng(2).normal(size=250)),
    "two values": [1.0] * 200 + [2.0] * 200,
    "long tail": list(np.exp(np.random.default_rng(3).normal(size=400) * 6)),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_order_statistics_equal_sorting(frame, shape, limit):
    xs = SHAPES[shape]
    ranks = [0, 1, 37, 199, 200, 201, 280, 360, 399]
    got = order_statistics(column(frame, xs), {"x": ranks}, max_candidates=limit)["x"]
    want = sorted(xs)
    assert {r: got[r] for r in ranks} == {r: want[r] for r in ranks}


def test_order_statistics_of_wide_integers(frame):
    rng = np.random.default_rng(4)
    xs = [int(v) for v in rng.integers(-(2**62), 2**62, size=300)]
    got = order_statistics(column(frame, xs, "long"), {"x": [0, 100, 299]}, max_candidates=10)["x"]
    assert [got[0], got[100], got[299]] == [sorted(xs)[i] for i in (0, 100, 299)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.integers(-10**6, 10**6)), min_size=2, max_size=60))
def test_order_statistics_property(spark, xs):
    kept = sorted(x for x in xs if x is not None)
    if not kept:
        return
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    ranks = list(range(0, len(kept), 7))
    assert order_statistics(df, {"x": ranks}, max_candidates=4)["x"] == {r: kept[r] for r in ranks}


def test_quantiles_equal_numpy(frame):
    xs = SHAPES["long tail"]
    probs = [0, 0.2, 0.33, 0.5, 0.67, 0.75, 1]
    got = quantiles(column(frame, xs), {"x": probs}, max_candidates=30)["x"]
    np.testing.assert_allclose(got, np.percentile(xs, [p * 100 for p in probs]), rtol=1e-12)


@pytest.mark.parametrize(
    "xs",
    [
        list(np.random.default_rng(5).integers(0, 30, size=200).astype(float)),
        SHAPES["long tail"], [7.0] * 6, [1.0, 1.0, 1.0, 1.0, 1.0, 9.0], [3.0], [None, 1.0, 2.0, 3.0, None, 4.0, 5.0, 6.0],
    ],
    ids=["ties", "long tail", "constant", "two edges", "single row", "nulls"],
)
def test_quintiles_equal_qcut(frame, xs):
    got = dict(values(q.with_quintiles(column(frame, xs), {"x": "code"}), "id", "code"))
    want = pd.qcut(pd.Series(xs, dtype=float), q=5, labels=False, duplicates="drop")
    assert got == {i: (None if pd.isna(w) else int(w)) for i, w in enumerate(want)}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 20, 100])
def test_value_at_share_of_rows(frame, n):
    xs = [float(v) for v in np.random.default_rng(n).permutation(n)]
    got = q.sorted_value_at(column(frame, xs), "x", [0.9, 0.7])
    assert got == [sorted(xs)[int(n * 0.9)], sorted(xs)[int(n * 0.7)]]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("k", [0, 1, 30, 99, 150, 400])
def test_extreme_rows_are_exactly_k(frame, largest, k):
    xs = [float(i % 4) for i in range(200)]  # every value is a tie of fifty rows
    df = column(frame, xs)
    got = {r[0] for r in values(df.where(extreme_rows(df, "x", "id", k, largest)), "id")}
    order = sorted(range(200), key=lambda i: (-xs[i] if largest else xs[i], i))
    assert got == set(order[:k])


@pytest.mark.parametrize("parts", [1, 8])
def test_row_index_does_not_move_with_partitions(frame, parts):
    df = frame([(f"c{i:03d}",) for i in range(150)], "name string", parts)
    got = values(with_row_index(df, [F.col("name")], start=1), "name", "row_index")
    assert got == [(f"c{i:03d}", i + 1) for i in range(150)]


def test_running_total(frame):
    df = frame([(float(i), i % 3) for i in range(100)], "s double, n long")
    got = values(running_total(df, "s", ["n"]), "s", "n_before")
    assert got == sorted(((float(i), sum(j % 3 for j in range(i))) for i in range(100)), key=repr)


def test_normal_map_is_monotone_and_centred(frame):
    xs = list(range(999)) + [None]
    df = column(frame, [None if x is None else float(x) for x in xs])
    rows = values(q.apply_normal_map(df, quantile_marks(df, ["x"])), "id", "x_normal")
    out = [v for _, v in sorted(rows, key=lambda r: r[0])]
    assert out[-1] is None
    assert all(a <= b for a, b in zip(out[:-2], out[1:-1]))
    assert abs(out[499]) < 0.02 and out[0] < -5 and out[998] > 5


@pytest.mark.parametrize("most", [2, 7, 100, 1000])
def test_marks_are_exact_quantiles(frame, most):
    rng = np.random.default_rng(most)
    xs = [(float(a), int(b), None if c < 0.3 else float(c), 1.5) for a, b, c in zip(rng.normal(size=501), rng.integers(0, 4, 501), rng.random(501))]
    xs += [(float("nan"), 1, None, 1.5)]
    got = quantile_marks(frame(xs, "x double, y int, z double, w double", 5), ["x", "y", "z", "w"], most)
    for i, c in enumerate("xyzw"):
        column_ = [r[i] for r in xs if r[i] is not None and r[i] == r[i]]
        np.testing.assert_allclose(got[c], np.quantile(column_, np.linspace(0, 1, min(most, 502))), rtol=1e-12, atol=1e-12)


def test_marks_of_small_columns(frame):
    schema = "x double, y double"
    assert quantile_marks(frame([(2.0, None)], schema), ["x", "y"]) == {"x": [2.0], "y": []}
    assert quantile_marks(frame([(2.0, None)], schema).where("x > 9"), ["x", "y"]) == {"x": [], "y": []}
    assert quantile_marks(frame([(2.0, 1.0), (None, 1.0), (3.0, None)], schema), ["x", "y"]) == {"x": [2.0, 2.5, 3.0], "y": [1.0, 1.0, 1.0]}


def test_normal_map_is_a_stage_that_can_be_kept(spark, frame, tmp_path):
    rng = np.random.default_rng(0)
    df = frame([(i, float(a), float(b), "x") for i, (a, b) in enumerate(rng.random((300, 2)))], "id long, x double, y double, x_normal string")
    stage = NormalMap(inputCols=["x", "y"], outputCol="both", quantiles=50)
    stage.write().save(f"{tmp_path}/stage")
    model = NormalMap.load(f"{tmp_path}/stage").fit(df)
    assert {c: len(v) for c, v in model.marks.items()} == {"x": 50, "y": 50}
    model.write().save(f"{tmp_path}/model")
    loaded = NormalMapModel.load(f"{tmp_path}/model")
    assert loaded.marks == model.marks and loaded.uid == model.uid
    a, b = (values(m.transform(df), "id", "both", "x_normal") for m in (model, loaded))
    assert a == b and all(r[2] == "x" for r in a)
    odd = frame([(1, None, 0.5)], "id long, x double, y double")
    assert model.transform(odd).first()["both"][0] == 0.0


def test_inverse_normal_known_points():
    got = q.inverse_normal(np.array([0.5, 0.975, 0.025, 1e-7, 0.8413447460685429]))
    np.testing.assert_allclose(got, [0, 1.959963984540054, -1.959963984540054, -5.199337582192816, 1.0], atol=1e-9)
