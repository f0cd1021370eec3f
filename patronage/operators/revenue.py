"""Revenue target and value segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.functions.scalar import keyed_normal
from patronage.operators.selection import quantiles, scalars

# Noise spread, segment cuts and names.
NOISE_SD = 0.1
NOISE_FLOOR = 0.1
LOW_CUT, HIGH_CUT = 0.33, 0.67
HIGH, MEDIUM, LOW = "High Value", "Medium Value", "Low Value"


def revenue_target(df: DataFrame, noise: float = 0.0, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Money scaled by frequency, recency and loyalty; never below 0."""
    s = scalars(df, lo=F.min("frequency"), hi=F.max("frequency"))
    if s["lo"] is None:
        return df.withColumn("target_revenue", F.lit(None).cast("double"))
    lo, hi = float(s["lo"]), float(s["hi"])
    target = (
        F.col("monetary").cast("double")
        * (1 + (F.col("frequency") - F.lit(lo)) / F.lit(hi - lo + 1))
        * (1 + F.col("recency_score") / F.lit(4.0))
        * (1 + F.col("rfm_score") / F.lit(15.0))
    )
    if noise:
        target = target * F.greatest(1 + F.lit(float(noise)) * keyed_normal(F.col(key), seed), F.lit(NOISE_FLOOR))
    return df.withColumn("target_revenue", F.when(target < 0, 0.0).otherwise(target))


def drop_null_targets(df: DataFrame) -> DataFrame:
    return df.where("target_revenue is not null")


def no_prediction(df: DataFrame) -> DataFrame:
    """Result when no row has a target, or nothing could be predicted."""
    return df.withColumns({"predicted_revenue": F.lit(0.0), "revenue_segment": F.lit(MEDIUM)})


def value_segments(df: DataFrame, column: str = "predicted_revenue") -> DataFrame:
    """High from the 67th percentile on, Medium from the 33rd, else Low."""
    low, high = quantiles(df, {column: [LOW_CUT, HIGH_CUT]})[column]
    if low is None:
        return df.withColumn("revenue_segment", F.lit(MEDIUM))
    c = F.col(column)
    return df.withColumn(
        "revenue_segment", F.when(c >= F.lit(high), HIGH).when(c >= F.lit(low), MEDIUM).when(c < F.lit(low), LOW).otherwise(MEDIUM)
    )


def result_columns(df: DataFrame) -> DataFrame:
    """History columns of a revenue result."""
    def pick(name, default):
        return F.col(name) if name in df.columns else F.lit(default)

    return df.withColumns(
        {
            "total_revenue": pick("monetary", 0.0),
            "transaction_count": pick("frequency", 0),
            "avg_transaction_value": pick("avg_order_value", 0.0),
        }
    )
