"""Recency / frequency / monetary features and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.functions.scalar import at_least, dtype, is_numeric, is_temporal, parse_instant, parse_number, whole_days
from patronage.operators.mapping import parse_date_columns
from patronage.operators.quantiles import with_quintiles
from patronage.operators.rollups import recent_activity
from patronage.session import materialize

# Columns each input is taken from, first existing one wins.
RECENCY_SOURCES = ["last_purchase_date", "last_activity", "days_since_last_purchase", "last_purchase"]
FREQUENCY_SOURCES = {"churn": ["total_orders", "transaction_count", "frequency"],
                     "revenue": ["total_orders", "transaction_count"]}
MONETARY_SOURCES = {"churn": ["total_spend", "transaction_amount", "monetary", "total_amount"],
                    "revenue": ["total_spend", "total_amount", "total_revenue"]}

# Model inputs of the two models.
CHURN_FEATURES = ["recency_days", "frequency", "monetary", "rfm_score", "recency_score", "frequency_score",
                  "monetary_score", "customer_tenure", "purchase_velocity", "recent_activity_30d",
                  "recent_activity_60d", "frequency_trend"]
REVENUE_FEATURES = ["recency_days", "frequency", "monetary", "rfm_score", "recency_score", "frequency_score",
                    "monetary_score", "avg_order_value", "purchase_frequency", "customer_lifetime_months",
                    "revenue_velocity", "spending_growth"]


class MissingInput(ValueError):
    """A table has no column a feature can be taken from."""


def _source(df: DataFrame, names: list[str], what: str) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise MissingInput(f"no column for {what}: need one of {names}")


def with_recency(df: DataFrame, as_of) -> DataFrame:
    """``recency_days``: whole days from the last purchase to ``as_of``."""
    name = _source(df, RECENCY_SOURCES, "recency")
    t = dtype(df, name)
    c = F.col(name).cast("long") if is_numeric(t) else whole_days(parse_instant(F.col(name), t), as_of)
    return df.withColumn("recency_days", c)


def with_frequency(df: DataFrame, kind: str = "churn") -> DataFrame:
    return df.withColumn("frequency", F.col(_source(df, FREQUENCY_SOURCES[kind], "frequency")))


def with_monetary(df: DataFrame, kind: str = "churn") -> DataFrame:
    return df.withColumn("monetary", F.col(_source(df, MONETARY_SOURCES[kind], "money")))


def rfm_inputs(df: DataFrame, as_of, kind: str = "churn") -> DataFrame:
    """The three raw metrics; also turns date-named text columns into timestamps."""
    df = with_recency(parse_date_columns(df), as_of)
    return with_monetary(with_frequency(df, kind), kind)


def neutral_features(df: DataFrame) -> DataFrame:
    """Neutral stand-ins for a table that cannot supply the metrics."""
    return df.withColumns(
        {"recency_days": F.lit(0).cast("long"), "frequency": F.lit(1).cast("long"),
         "monetary": F.lit(1.0), "rfm_score": F.lit(0)}
    )


SCORES = {"recency_days": "recency_score", "frequency": "frequency_score", "monetary": "monetary_score"}


def score_rfm(df: DataFrame, kind: str = "churn") -> DataFrame:
    """Quintile codes of the three metrics and their sum.

    ``df`` is scanned a few times, so it should be a table or a written stage.
    For revenue the recency code is turned round: recent means high.
    """
    out = with_quintiles(df, SCORES)
    if kind == "revenue":
        out = out.withColumn("recency_score", F.lit(4) - F.col("recency_score"))
    total = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    return out.withColumn("rfm_score", total)


def rfm_features(df: DataFrame, as_of, kind: str = "churn", on_missing: str = "raise") -> DataFrame:
    """Metrics, codes and score of each customer; the metrics are written once."""
    try:
        staged = materialize(rfm_inputs(df, as_of, kind), f"rfm-{kind}")
    except MissingInput:
        if on_missing != "neutral":
            raise
        return neutral_features(df)
    return score_rfm(staged, kind)


def tenure_features(df: DataFrame) -> DataFrame:
    """Tenure, purchase velocity and frequency trend."""
    if "frequency" in df.columns:
        df = df.withColumn("frequency", F.coalesce(_number(df, "frequency"), F.lit(1.0)))
    if "recency_days" in df.columns:
        df = df.withColumn("recency_days", F.coalesce(_number(df, "recency_days"), F.lit(1.0)))
    span = {"first_purchase_date", "last_purchase_date"}
    if span <= set(df.columns) and all(is_temporal(dtype(df, c)) for c in span):
        tenure = whole_days(F.col("first_purchase_date"), F.col("last_purchase_date")).cast("double")
    else:
        tenure = F.col("recency_days") + F.col("frequency") * 30
    df = df.withColumn("customer_tenure", tenure)
    pace = F.col("frequency") / at_least(F.col("customer_tenure"), 1.0)
    return df.withColumns({"purchase_velocity": pace, "frequency_trend": pace})


def _number(df: DataFrame, name: str):
    c = F.col(name)
    return c.cast("double") if is_numeric(dtype(df, name)) else parse_number(c.cast("string"))


def activity_features(df: DataFrame, transactions: DataFrame | None, as_of) -> DataFrame:
    """Transactions in the last 30 and 60 days, 0 without any."""
    names = ["recent_activity_30d", "recent_activity_60d"]
    if transactions is None or "transaction_date" not in transactions.columns:
        return df.withColumns({c: F.lit(0).cast("long") for c in names})
    joined = df.join(recent_activity(transactions, as_of), "customer_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names})


def temporal_features(df: DataFrame, transactions: DataFrame | None, as_of) -> DataFrame:
    return activity_features(tenure_features(df), transactions, as_of)


def value_features(df: DataFrame) -> DataFrame:
    """Order value, purchase frequency, lifetime, velocity and growth."""
    recency, frequency, money = F.col("recency_days"), F.col("frequency"), F.col("monetary")
    return df.withColumns(
        {
            "avg_order_value": money / at_least(frequency.cast("double"), 1.0),
            "purchase_frequency": frequency / at_least(recency.cast("double"), 1.0) * 365,
            "customer_lifetime_months": at_least(recency / 30, 1.0),
            "revenue_velocity": money / at_least(recency.cast("double"), 1.0),
        }
    ).withColumn("spending_growth", F.col("avg_order_value") * F.col("purchase_frequency"))


def feature_matrix(df: DataFrame, candidates: list[str], vector: str | None = "features") -> tuple[DataFrame, list[str]]:
    """Existing model inputs as doubles without nulls, assembled into one vector."""
    names = [c for c in candidates if c in df.columns]
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    if vector is None:
        return filled, names
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol=vector).transform(filled), names
