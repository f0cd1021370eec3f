"""Sums that lose nothing and do not depend on the order of the rows."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from patronage.functions.sums import exact_mean, exact_sum, exact_total
from patronage.operators import reports, rollups

INF, NAN = math.inf, math.nan


def total(frame, xs, parts=3):
    df = frame([(x,) for x in xs], "amount double", parts)
    return df.agg(exact_total(df, "amount").alias("t")).first()["t"]


def near(got, want):
    return got == want or abs(got - want) <= math.ulp(want) or math.isnan(got) and math.isnan(want)


CASES = {
    "far apart": [1e33, 1e-30, 5.25, -1e33, 3e-30],
    "large and small": [1e33, 1e-30],
    "cents": [0.1] * 1000 + [0.2] * 1000,
    "cancelling": [1e16, 1.0, -1e16, 1e-9],
    "negative": [-0.1] * 77 + [0.3, -1e20, 7e-12],
    "small negative": [1.0, -1.0 - 2**-52],
    "zeros": [0.0, -0.0],
    "tiny": [1e-40, 2e-40, -5e-45],
    "bits": [2.0**k for k in range(-156, 130)],
    "infinite": [INF, 1.0],
    "minus infinite": [-INF, 1e300],
    "both infinities": [INF, -INF, 3.0],
    "huge": [1e300, 1e300, -1e300, 1e39],
    "below all bins": [5e-324, 1e-300],
}


@pytest.mark.parametrize("name", CASES)
def test_totals(frame, name):
    xs = CASES[name]
    want = math.fsum(xs) if all(map(math.isfinite, xs)) else sum(xs)
    assert near(total(frame, xs), want)
    assert near(total(frame, [*xs, None, NAN]), want)


def test_nothing_to_add(frame):
    assert total(frame, [None, NAN]) == 0.0 and total(frame, []) == 0.0
    df = frame([(None,), (NAN,)], "amount double")
    assert df.agg(exact_sum(F.lit(None).cast("double")), exact_mean(df, "amount")).first() == (None, None)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(min_value=-1e38, max_value=1e38, allow_nan=False).filter(lambda x: x == 0 or abs(x) > 1e-31), max_size=40))
def test_any_doubles_add_to_the_nearest(frame, xs):
    assert near(total(frame, xs), math.fsum(xs))


def test_order_and_partitions_do_not_matter(frame):
    rng = random.Random(1)
    xs = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-30, 33) for _ in range(3000)]
    totals = set()
    for parts in (1, 2, 7, 16):
        rng.shuffle(xs)
        totals.add(total(frame, xs, parts))
    assert len(totals) == 1 and near(totals.pop(), math.fsum(xs))


def test_other_types(frame):
    df = frame([(1, 2.5), (2, 0.1)], "a long, b float")
    assert df.agg(exact_total(df, "a")).first()[0] == 3
    assert df.agg(exact_total(df, "b")).first()[0] == 2.5 + float(np.float32(0.1))


EDGE = [("a", 1e33), ("a", 1e-30), ("b", INF), ("b", 1.0), ("c", NAN), ("c", 1.0), ("d", 1e-30), ("d", 2e-30), ("e", NAN), ("f", None), (None, 5.0)]


def test_rollups_of_extreme_amounts(frame):
    df = frame(EDGE, "customer_id string, amount double").withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz"))
    want = {"a": (1e33, 2), "b": (INF, 2), "c": (1.0, 1), "d": (3e-30, 2), "e": (0.0, 0), "f": (0.0, 0)}
    rolled = {r.customer_id: (r.total_amount, r.transaction_count) for r in rollups.customer_rollup(df, "2024-01-02").collect()}
    metrics = {r.customer_id: (r.total_revenue, r.transaction_count, r.avg_revenue, r.customer_lifetime_value) for r in rollups.revenue_metrics(df).collect()}
    prepared = {r.customer_id: (r.total_amount, r.transaction_count) for r in rollups.prepare_features(df, "2024-01-02").collect()}
    for k, (t, n) in want.items():
        assert rolled[k] == prepared[k] == (pytest.approx(t, rel=1e-15), n)
        assert metrics[k] == (pytest.approx(t, rel=1e-15), n, pytest.approx(t / n, rel=1e-15) if n else None, pytest.approx(t * n, rel=1e-15))


def test_reports_of_extreme_amounts(frame):
    df = frame(EDGE, "customer_id string, amount double").where("customer_id <> 'b'").withColumns(
        {"date": F.lit("2024-01-01").cast("date"), "risk_level": F.lit("High Risk"), "total_revenue": F.col("amount"), "country": F.col("customer_id")}
    )
    whole = pytest.approx(1e33 + 1.0, rel=1e-15)
    o = reports.overview(df).first()
    assert (o.total_revenue, o.transactions) == (whole, 8) and o.avg_transaction == pytest.approx((1e33 + 1) / 5, rel=1e-15)
    assert reports.kpis(df).first().total_revenue == whole
    assert reports.monthly_totals(df, "date", "amount", "v").first().v == whole
    assert [tuple(r) for r in reports.top_by_sum(df, "country", "amount", "v", 3).collect()] == [("a", 1e33), ("c", 1.0), ("d", pytest.approx(3e-30))]
    inf = frame(EDGE, "customer_id string, amount double")
    assert reports.overview(inf).first().total_revenue == reports.overview(inf).first().avg_transaction == INF
