"""Rule-based churn probability, labels and risk levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from patronage.functions.scalar import keyed_normal
from patronage.operators.selection import extreme_rows, order_statistics, scalars, unique_number

# Weights of the probability, label and risk cuts, level names.
WEIGHTS = {"recency_days": 0.35, "frequency": 0.30, "monetary": 0.25, "rfm_score": 0.10}
LABEL_CUT = 0.6
NOISE_SD = 0.08
CHURN_SHARE = 0.25
MIN_SHARE = 0.05
EXCESS = 1.5
HIGH, MEDIUM, LOW = "High Risk", "Medium Risk", "Low Risk"
LEVELS = [HIGH, MEDIUM, LOW]
HIGH_SHARE, MEDIUM_SHARE = 0.9, 0.7
FIXED_HIGH, FIXED_MEDIUM = 0.4, 0.2
SMALL = 10


def churn_probability(df: DataFrame, noise: float = 0.0, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Weighted distance from the best value of each metric, clipped to 0..1.

    A metric that is absent, or whose maximum is not positive, has no part.
    """
    present = [c for c in WEIGHTS if c in df.columns]
    tops = scalars(df, **{c: F.max(c) for c in present}) if present else {}
    p = F.lit(0.0)
    for c in present:
        top = tops[c]
        if top is None or top <= 0:
            continue
        share = F.col(c) / F.lit(float(top))
        p = p + F.lit(WEIGHTS[c]) * (share if c == "recency_days" else 1 - share)
    if noise:
        p = p + F.lit(float(noise)) * keyed_normal(F.col(key), seed)
    clipped = F.when(p < 0, 0.0).when(p > 1, 1.0).otherwise(p)
    return df.withColumn("churn_probability", clipped)


def initial_label(df: DataFrame, p: str = "churn_probability") -> DataFrame:
    return df.withColumn("churn_label", F.coalesce((F.col(p) > LABEL_CUT).cast("int"), F.lit(0)))


def class_counts(df: DataFrame) -> tuple[int, int]:
    """Rows, and rows labelled as churned."""
    s = scalars(df, n=F.count(F.lit(1)), churned=F.coalesce(F.sum("churn_label"), F.lit(0)))
    return s["n"], s["churned"]


def balance_labels(
    df: DataFrame, mode: str = "as_written", p: str = "churn_probability", key: str = "customer_id", counts=None
) -> DataFrame:
    """Move labels towards a usable class balance; only the first matching case acts.

    ``as_written`` ranks all rows, so it may pick rows that already have the
    wanted label; ``intended`` ranks only the class to be changed.
    """
    if mode not in ("as_written", "intended"):
        raise ValueError(mode)
    names = df.columns
    n, churned = counts or class_counts(df)
    floor, target = max(2, int(n * MIN_SHARE)), int(n * CHURN_SHARE)
    if churned < floor:
        k, value = floor - churned, 1
    elif n - churned < floor:
        k, value = churned - (n - floor), 0
    elif churned > target * EXCESS:
        k, value = churned - target, 0
    else:
        return df
    df, key = unique_number(df, key)
    pool = df if mode == "as_written" else df.where(F.col("churn_label") == 1 - value)
    picked = extreme_rows(pool, p, key, k, largest=value == 1)
    if mode == "intended":
        picked = picked & (F.col("churn_label") == 1 - value)
    out = df.withColumn("churn_label", F.when(picked, value).otherwise(F.col("churn_label")))
    return out.select(*names)


def ensure_both_classes(
    df: DataFrame, p: str = "churn_probability", key: str = "customer_id", counts=None
) -> DataFrame:
    """At least one row of each class, judged by the counts before either fix."""
    n, churned = counts or class_counts(df)
    if not n or 0 < churned < n:
        return df
    s = scalars(
        df,
        top=F.min_by(key, F.struct((-F.col(p)).alias("a"), F.col(key).alias("b"))),
        bottom=F.min_by(key, F.struct(F.col(p).alias("a"), F.col(key).alias("b"))),
    )
    label = F.col("churn_label")
    if churned < 1:
        label = F.when(F.col(key) == F.lit(s["top"]), 1).otherwise(label)
    if n - churned < 1:
        label = F.when(F.col(key) == F.lit(s["bottom"]), 0).otherwise(label)
    return df.withColumn("churn_label", label)


def label_churn(
    df: DataFrame, noise: float = 0.0, seed: int = 42, mode: str = "as_written", key: str = "customer_id"
) -> DataFrame:
    """Probability, label, balance and class guard in one go."""
    return label_rows(churn_probability(df, noise, seed, key), mode, key)


def label_rows(df: DataFrame, mode: str = "as_written", key: str = "customer_id") -> DataFrame:
    """Label, balance and class guard of rows that have their probability."""
    scored = initial_label(df)
    return _settle_labels(scored, mode, key, class_counts(scored))


def _settle_labels(scored: DataFrame, mode: str, key: str, counts: tuple[int, int]) -> DataFrame:
    balanced = balance_labels(scored, mode, key=key, counts=counts)
    return ensure_both_classes(balanced, key=key, counts=counts if balanced is scored else None)


def risk_levels(
    df: DataFrame, p: str = "churn_probability_final", key: str = "customer_id", n: int | None = None
) -> DataFrame:
    """High from the value at sorted position ``int(.9 n)`` on, Medium from ``int(.7 n)``.

    Below ten rows the levels go by rank instead. ``df`` is scanned again for
    the thresholds, so ``p`` must read the same values each time. ``n`` is its
    number of rows, if known.
    """
    n = df.count() if n is None else n
    if n < SMALL:
        return _risk_by_rank(df, n, p, key)
    value = F.coalesce(F.col(p), F.lit(0.0))
    ranks = [int(n * HIGH_SHARE), int(n * MEDIUM_SHARE)]
    cuts = order_statistics(df.select(value.alias("_p")), {"_p": ranks}, {"_p": n})["_p"]
    high, medium = cuts[ranks[0]], cuts[ranks[1]]
    level = F.when(value >= F.lit(high), HIGH).when(value >= F.lit(medium), MEDIUM).otherwise(LOW)
    return df.withColumn("risk_level", level)


def _risk_by_rank(df: DataFrame, n: int, p: str, key: str) -> DataFrame:
    # Fewer than ten rows by construction, so one window over all is fine.
    place = F.row_number().over(Window.orderBy(F.col(p).desc_nulls_last(), F.col(key)))
    last_medium = max(2, math.ceil(n * 0.3)) if n > 3 else 2
    level = F.when(place == 1, HIGH).when(place <= last_medium, MEDIUM).otherwise(LOW)
    return df.withColumn("risk_level", level)


def fixed_risk_levels(df: DataFrame, p: str = "churn_probability_final") -> DataFrame:
    """Levels by fixed cuts."""
    c = F.col(p)
    return df.withColumn("risk_level", F.when(c >= FIXED_HIGH, HIGH).when(c >= FIXED_MEDIUM, MEDIUM).otherwise(LOW))


def relabel_if_weak(df: DataFrame, accuracy: float | None, p: str = "churn_probability_final") -> DataFrame:
    """Fall back to fixed cuts after a weak model, or when nobody is above Low."""
    raised = scalars(df, k=F.count_if(F.col("risk_level").isin(HIGH, MEDIUM)))["k"]
    weak = (accuracy is not None and accuracy < 0.5) or raised == 0
    return fixed_risk_levels(df, p) if weak else df


def score_by_rules(df: DataFrame, noise: float = 0.0, seed: int = 42, mode: str = "as_written") -> DataFrame:
    """Probability, label and risk level without a model.

    ``df`` holds the features as read from a table or a written stage; what is
    added is arithmetic on them, the same in every pass.
    """
    scored = initial_label(churn_probability(df, noise, seed))
    counts = class_counts(scored)
    return risk_levels(_settle_labels(scored, mode, "customer_id", counts), "churn_probability", n=counts[0])
