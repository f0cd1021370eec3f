"""Whole analyses: churn, revenue, and a stored run of both."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from patronage.operators import churn, features, mapping, models, revenue, rollups
from patronage.operators.features import CHURN_FEATURES, REVENUE_FEATURES
from patronage.operators.joins import attach_metrics
from patronage.operators.reports import run_summary
from patronage.session import materialize


def _ready(df: DataFrame, order_by: list | None) -> DataFrame:
    """Customer ids and a run key on every row."""
    if "customer_id" not in df.columns:
        if not order_by:
            raise ValueError("a table without customer_id needs order_by to number its rows")
        df = mapping.number_customers(df, order_by)
    return df if "analysis_id" in df.columns else df.withColumn("analysis_id", F.lit(str(uuid.uuid4())))


def churn_features(customers: DataFrame, as_of, transactions: DataFrame | None = None, on_missing: str = "raise") -> DataFrame:
    scored = features.rfm_features(customers, as_of, "churn", on_missing)
    return features.temporal_features(scored, transactions, as_of)


def analyze_churn(
    customers: DataFrame, as_of, transactions: DataFrame | None = None, *, noise: float = 0.0, seed: int = 42,
    mode: str = "as_written", settings: dict | None = models.CHURN_GRID, on_missing: str = "raise",
    order_by: list | None = None, fitted: models.Fitted | None = None,
    keep_model: Callable[[models.Fitted], None] | None = None, **training,
) -> tuple[DataFrame, DataFrame]:
    """Scored customers with risk levels, and one row describing the model.

    A model is trained unless ``fitted`` is given, such as one of an earlier
    run; ``keep_model`` is handed the model that was used.
    """
    df = churn_features(_ready(customers, order_by), as_of, transactions, on_missing)
    df = materialize(churn.churn_probability(df, noise, seed), "churn-features")
    df = churn.label_rows(df, mode)
    table, names = features.feature_matrix(df, CHURN_FEATURES)
    fitted = fitted or models.train_churn(table, names, settings=settings, **training)
    scored = materialize(models.score_churn(fitted, table).drop("features"), "churn-scored")
    metrics = models.evaluate_churn(fitted)
    if keep_model:
        keep_model(fitted)
    levels = churn.relabel_if_weak(churn.risk_levels(scored), metrics["accuracy"])
    return levels, models.model_run(df, "EnhancedRandomForest", fitted.used, metrics)


def analyze_revenue(
    customers: DataFrame, as_of, *, noise: float = 0.0, seed: int = 42, settings: dict | None = models.REVENUE_GRID,
    on_missing: str = "raise", order_by: list | None = None, fitted: models.Fitted | None = None,
    keep_model: Callable[[models.Fitted], None] | None = None, **training,
) -> tuple[DataFrame, DataFrame]:
    """Customers with predicted revenue and value segment, and one model row; ``fitted`` and ``keep_model`` as above."""
    ready = _ready(customers, order_by)
    df = features.rfm_features(ready, as_of, "revenue", on_missing)
    for c in ("recency_score", "frequency_score", "monetary_score"):
        if c not in df.columns:  # neutral features carry no codes, so there is no target either
            df = df.withColumn(c, F.lit(None).cast("int"))
    df = revenue.drop_null_targets(revenue.revenue_target(features.value_features(df), noise, seed))
    df = materialize(df, "revenue-features")
    if df.isEmpty():
        return revenue.no_prediction(ready), models.model_run(ready, "EnhancedRandomForestRegressor", [], {})
    table, names = features.feature_matrix(df, REVENUE_FEATURES)
    fitted = fitted or models.train_revenue(table, names, settings=settings, **training)
    scored = materialize(models.score_revenue(fitted, table).drop("features"), "revenue-scored")
    metrics = models.evaluate_revenue(fitted)
    if keep_model:
        keep_model(fitted)
    out = revenue.result_columns(revenue.value_segments(scored))
    return out, models.model_run(df, "EnhancedRandomForestRegressor", fitted.used, metrics)


def analyze_revenue_tables(customers: DataFrame, transactions: DataFrame, as_of, **options) -> tuple[DataFrame, DataFrame]:
    """The revenue analysis from a customer and a transaction table."""
    merged = attach_metrics(customers, rollups.revenue_metrics(transactions))
    return analyze_revenue(merged, as_of, **options)


def process_tables(
    customers: DataFrame, transactions: DataFrame, customer_roles: dict, transaction_roles: dict,
    customer_order: list | None = None, transaction_order: list | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mapped, completed and typed customer and transaction tables."""
    from patronage.operators.cleaning import with_dates, with_numbers

    c = mapping.rename_roles(customers, customer_roles)
    t = mapping.rename_roles(transactions, transaction_roles)
    if "customer_id" not in c.columns:
        if "customer_id" in t.columns:
            seen = "date" if "date" in t.columns else "customer_id"
            c = mapping.ids_by_position(c, customer_order, t, seen)
        else:
            c = mapping.number_customers(c, customer_order)
    if "date" not in t.columns:
        t = mapping.dates_by_position(t, transaction_order)
    t = mapping.transaction_defaults(mapping.amount_from_first_number(t))
    return mapping.customer_defaults(c), with_numbers(with_dates(t, "date"), {"amount": None})


def score_customers(transactions: DataFrame, as_of) -> DataFrame:
    """Features, rule-based churn probability, label and risk level per customer."""
    rolled = rollups.customer_rollup(transactions, as_of)
    return churn.score_by_rules(features.rfm_features(rolled, as_of, "churn"))


def segment_customers(transactions: DataFrame, as_of) -> DataFrame:
    """Revenue features, target and value segment per customer, without a model."""
    rolled = rollups.customer_rollup(transactions, as_of)
    scored = features.value_features(features.rfm_features(rolled, as_of, "revenue"))
    target = revenue.drop_null_targets(revenue.revenue_target(scored))
    return revenue.value_segments(materialize(target, "revenue-target"), "target_revenue")


def churn_run_summary(df: DataFrame) -> DataFrame:
    return run_summary(df, "churn_probability_final", "risk_level", churn.LEVELS)


def revenue_run_summary(df: DataFrame) -> DataFrame:
    return run_summary(df, "predicted_revenue", "revenue_segment", [revenue.HIGH, revenue.MEDIUM, revenue.LOW])
