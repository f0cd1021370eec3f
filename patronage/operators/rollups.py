"""Customer-grain rollups. One partially combined shuffle on the customer each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions.scalar import dtype, instant, parse_instant, whole_days
from patronage.functions.sums import amounts, exact_total
from patronage.operators.joins import attach_pairs
from patronage.operators.mapping import alias_columns
from patronage.operators.selection import scalars

METRICS = ["total_amount", "transaction_count", "days_since_last_purchase"]


def total(c) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def customer_rollup(
    transactions: DataFrame,
    as_of=None,
    demographics: list[str] | None = None,
    order_by: list[str] | None = None,
    first_date: bool = False,
) -> DataFrame:
    """Amount, count, last purchase and its age, first-seen demographics.

    Everything comes out of a single aggregation, including the first
    demographic row (by ``order_by``), so no join is needed.
    """
    has_date = "date" in transactions.columns
    aggs = [exact_total(transactions, "amount").alias("total_amount"), amounts(transactions, "amount").alias("transaction_count")]
    if has_date:
        when = parse_instant(F.col("date"), dtype(transactions, "date"))
        if first_date:
            aggs.append(F.min(when).alias("first_purchase"))
        aggs.append(F.max(when).alias("last_purchase"))
    if demographics:
        order = order_by or (["date"] if has_date else demographics)
        aggs.append(F.min_by(F.struct(*demographics), F.struct(*order)).alias("_demo"))
    out = transactions.where("customer_id is not null").groupBy("customer_id").agg(*aggs)
    if has_date and as_of is not None:
        out = out.withColumn("days_since_last_purchase", whole_days(F.col("last_purchase"), as_of))
    if demographics:
        out = out.select(*[c for c in out.columns if c != "_demo"], "_demo.*")
    return out


def one_row_per_customer(df: DataFrame) -> bool:
    """Grain test: as many customers as rows."""
    s = scalars(df, n=F.count(F.lit(1)), k=F.count_distinct("customer_id"))
    return s["n"] == s["k"]


def prepare_features(df: DataFrame, as_of, order_by: list[str] | None = None) -> DataFrame:
    """Churn input at customer grain from whatever grain ``df`` has.

    Already one row per customer with all three metrics: project. Transaction
    rows: roll up. Anything else: missing metrics become 0.
    """
    df = alias_columns(df)
    have = set(df.columns)
    demo = [c for c in ("age", "gender") if c in have]
    if {"customer_id", *METRICS} <= have and one_row_per_customer(df):
        return df.select("customer_id", *METRICS, *demo)
    if {"customer_id", "amount"} <= have:
        out = customer_rollup(df, as_of, demo, order_by)
        if "date" not in have and "days_since_last_purchase" in have:
            out = attach_pairs(out, df, "days_since_last_purchase")
        return out
    missing = [c for c in ("customer_id", *METRICS) if c not in have]
    return df.withColumns({c: F.lit(0) for c in missing})


def revenue_metrics(transactions: DataFrame) -> DataFrame:
    """Sum, mean, count, first and last purchase, lifetime value per customer."""
    return (
        transactions.where("customer_id is not null")
        .groupBy("customer_id")
        .agg(
            exact_total(transactions, "amount").alias("total_revenue"),
            amounts(transactions, "amount").alias("transaction_count"),
            F.min("date").alias("first_purchase"),
            F.max("date").alias("last_purchase"),
        )
        .withColumn("avg_revenue", F.when(F.col("transaction_count") > 0, F.col("total_revenue") / F.col("transaction_count")))
        .withColumn("customer_lifetime_value", F.col("total_revenue") * F.col("transaction_count"))
        .select("customer_id", "total_revenue", "avg_revenue", "transaction_count", "first_purchase", "last_purchase",
                "customer_lifetime_value")
    )


def recent_activity(transactions: DataFrame, as_of, date: str = "transaction_date") -> DataFrame:
    """Transactions per customer in the 30 and 60 days up to ``as_of``.

    The 60-day bound is a plain filter, so it reaches the scan.
    """
    end = instant(as_of)
    when = F.col(date)
    return (
        transactions.where(when >= end - F.make_dt_interval(F.lit(60)))
        .groupBy("customer_id")
        .agg(
            F.count_if(when >= end - F.make_dt_interval(F.lit(30))).alias("recent_activity_30d"),
            F.count("*").alias("recent_activity_60d"),
        )
    )
