import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import churn as c
from patronage.operators import features as f
from patronage.operators import revenue as r
from tests.conftest import values


def scored(frame, ps, labels=None):
    rows = [(i, float(p), None if labels is None else labels[i]) for i, p in enumerate(ps)]
    return frame(rows, "customer_id long, churn_probability double, churn_label int")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 9, 10, 20, 100])
def test_risk_levels_by_size(frame, n):
    ps = [float(v) for v in np.random.default_rng(n).permutation(n)]
    got = dict(values(c.risk_levels(scored(frame, ps), "churn_probability"), "customer_id", "risk_level"))
    if n >= 10:
        s = sorted(ps)
        hi, mid = s[int(n * 0.9)], s[int(n * 0.7)]
        want = {i: c.HIGH if p >= hi else c.MEDIUM if p >= mid else c.LOW for i, p in enumerate(ps)}
    else:
        order = sorted(range(n), key=lambda i: -ps[i])
        want = dict.fromkeys(range(n), c.LOW)
        want[order[0]] = c.HIGH
        for place in range(1, n):
            if place == 1 or (n > 3 and place < math.ceil(n * 0.3)):
                want[order[place]] = c.MEDIUM
    assert got == want


def test_ties_may_exceed_a_tenth(frame):
    got = values(c.risk_levels(scored(frame, [0.5] * 40), "churn_probability").groupBy("risk_level").count(), "risk_level", "count")
    assert got == [(c.HIGH, 40)]


def test_probability_skips_absent_and_empty_terms(frame):
    df = frame([(1, 10, 4, 0.0), (2, 0, 1, 0.0)], "customer_id long, recency_days long, frequency long, monetary double")
    got = values(c.churn_probability(df), "customer_id", "churn_probability")
    assert got == [(1, pytest.approx(0.35)), (2, pytest.approx(0.3 * 0.75))]


def test_noise_depends_on_key_and_seed_only(frame):
    rows = [(i, i % 50, 1 + i % 7, float(i)) for i in range(300)]
    schema = "customer_id long, recency_days long, frequency long, monetary double"
    a = values(c.churn_probability(frame(rows, schema, 1), c.NOISE_SD), "customer_id", "churn_probability")
    b = values(c.churn_probability(frame(rows, schema, 8), c.NOISE_SD), "customer_id", "churn_probability")
    other = values(c.churn_probability(frame(rows, schema, 8), c.NOISE_SD, seed=7), "customer_id", "churn_probability")
    clean = values(c.churn_probability(frame(rows, schema, 8)), "customer_id", "churn_probability")
    assert a == b and a != other
    noise = np.array([x[1] for x in a]) - np.array([x[1] for x in clean])
    assert abs(noise.mean()) < 0.02 and 0.05 < noise.std() < 0.1
    assert all(0 <= p <= 1 for _, p in a)


def reference_balance(ps, labels, intended):
    """The balance rule spelled out with plain lists."""
    n, churned = len(ps), sum(labels)
    m, target = max(2, int(n * 0.05)), int(n * 0.25)
    out = list(labels)
    down = sorted(range(n), key=lambda i: (-ps[i], i))
    up = sorted(range(n), key=lambda i: (ps[i], i))
    if churned < m:
        pool = [i for i in down if not intended or labels[i] == 0]
        for i in pool[: m - churned]:
            out[i] = 1
    elif n - churned < m or churned > target * 1.5:
        k = churned - (n - m) if n - churned < m else churned - target
        pool = [i for i in up if not intended or labels[i] == 1]
        for i in pool[:k]:
            out[i] = 0
    return out


@pytest.mark.parametrize("mode", ["as_written", "intended"])
@pytest.mark.parametrize("kind", ["none", "all", "one", "half", "low ones", "fine"])
def test_balance(frame, mode, kind):
    rng = np.random.default_rng(8)
    ps = [float(round(p, 1)) for p in rng.random(80)]  # rounding makes ties
    labels = {
        "none": [0] * 80, "all": [1] * 80, "one": [1] + [0] * 79, "half": [i % 2 for i in range(80)],
        "low ones": [int(p < 0.6) for p in ps], "fine": [int(i % 5 == 0) for i in range(80)],
    }[kind]
    out = c.balance_labels(scored(frame, ps, labels), mode)
    got = [label for _, label in values(out.orderBy("customer_id"), "customer_id", "churn_label")]
    by_id = dict(values(out, "customer_id", "churn_label"))
    assert [by_id[i] for i in range(80)] == reference_balance(ps, labels, mode == "intended")
    assert len(got) == 80


def test_balance_with_text_ids(frame):
    df = frame([(f"c{i:02d}", 0.5, 0) for i in range(50)], "customer_id string, churn_probability double, churn_label int")
    assert values(c.balance_labels(df).where("churn_label = 1"), "customer_id") == [("c00",), ("c01",)]


def test_both_classes(frame):
    ps = [0.2, 0.9, 0.9, 0.1]
    assert values(c.ensure_both_classes(scored(frame, ps, [0] * 4)), "customer_id", "churn_label") == [(0, 0), (1, 1), (2, 0), (3, 0)]
    assert values(c.ensure_both_classes(scored(frame, ps, [1] * 4)), "customer_id", "churn_label") == [(0, 1), (1, 1), (2, 1), (3, 0)]


def test_relabel_only_when_weak(frame):
    df = scored(frame, [0.5, 0.3, 0.1]).withColumn("risk_level", F.lit(c.HIGH)).withColumnRenamed("churn_probability", "churn_probability_final")
    assert {x for _, x in values(c.relabel_if_weak(df, 0.9), "customer_id", "risk_level")} == {c.HIGH}
    assert values(c.relabel_if_weak(df, 0.4), "customer_id", "risk_level") == [(0, c.HIGH), (1, c.MEDIUM), (2, c.LOW)]
    nobody = df.withColumn("risk_level", F.lit(c.LOW))
    assert values(c.relabel_if_weak(nobody, None), "customer_id", "risk_level") == [(0, c.HIGH), (1, c.MEDIUM), (2, c.LOW)]


def test_day_floor(frame):
    rows = [(1, "2024-01-30 00:00:01"), (2, "2024-01-30 00:00:00"), (3, "2024-01-31 06:00:00"), (4, None)]
    df = frame(rows, "customer_id long, last_purchase_date string")
    got = values(f.with_recency(df, "2024-01-31"), "customer_id", "recency_days")
    assert got == [(1, 0), (2, 1), (3, -1), (4, None)]


def test_value_features_keep_nulls(frame):
    df = frame([(1, None, 2, 8.0), (2, 0, 0, 8.0), (3, 60, 4, 8.0)], "customer_id long, recency_days long, frequency long, monetary double")
    got = values(f.value_features(df), "customer_id", "avg_order_value", "purchase_frequency", "customer_lifetime_months", "revenue_velocity")
    assert got == [(1, 4.0, None, None, None), (2, 8.0, 0.0, 1.0, 8.0), (3, 2.0, pytest.approx(4 / 60 * 365), 2.0, pytest.approx(8 / 60))]


def test_missing_inputs_raise_or_turn_neutral(frame):
    df = frame([(1, "x")], "customer_id long, name string")
    with pytest.raises(f.MissingInput):
        f.rfm_features(df, "2024-01-31")
    assert values(f.rfm_features(df, "2024-01-31", on_missing="neutral"), "recency_days", "frequency", "monetary", "rfm_score") == [(0, 1, 1.0, 0)]


def test_constant_metric_leaves_no_target(frame):
    df = frame([(i, i, 3, 5.0) for i in range(10)], "customer_id long, days_since_last_purchase long, transaction_count long, total_amount double")
    out = f.rfm_features(df, "2024-01-31", "revenue")
    assert {x[0] for x in values(out, "frequency_score")} == {None}
    assert r.drop_null_targets(r.revenue_target(out)).count() == 0


def test_value_segments(frame):
    xs = [float(v) for v in np.random.default_rng(3).permutation(50)]
    df = frame(list(enumerate(xs)), "customer_id long, predicted_revenue double")
    lo, hi = np.percentile(xs, [33, 67])
    want = sorted((i, r.HIGH if x >= hi else r.MEDIUM if x >= lo else r.LOW) for i, x in enumerate(xs))
    assert values(r.value_segments(df), "customer_id", "revenue_segment") == sorted(want, key=repr)
