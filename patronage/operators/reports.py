"""Report aggregates and ranked lists over scored customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.functions.scalar import is_numeric, month_label
from patronage.functions.sums import exact_mean, exact_total
from patronage.operators import churn
from patronage.operators.quantiles import above_quantile
from patronage.operators.selection import quantiles, scalars

P = "churn_probability_final"


def risk_level_counts(df: DataFrame) -> DataFrame:
    """Customers per risk level: all three levels, in order, 0 where none."""
    n = [F.count_if(F.col("risk_level") == level).alias(f"n{i}") for i, level in enumerate(churn.LEVELS)]
    levels = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(level).alias("risk_level"), F.col(f"n{i}").alias("customers"))
        for i, level in enumerate(churn.LEVELS)
    ])
    return df.agg(*n).select(F.explode(levels).alias("r")).select("r.*").orderBy("place")


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)
    )


def sum_by(df: DataFrame, column: str, amount: str, name: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(exact_total(df, amount).alias(name))


def top_by_sum(df: DataFrame, column: str, amount: str, name: str, n: int = 10) -> DataFrame:
    return sum_by(df, column, amount, name).orderBy(F.desc(name), column).limit(n)


def monthly_totals(df: DataFrame, date: str, amount: str, name: str) -> DataFrame:
    """Total per calendar month from the first to the last; months without rows show 0."""
    sums = (
        df.where(F.col(date).isNotNull())
        .groupBy(F.to_date(F.date_trunc("month", date)).alias("month"))
        .agg(exact_total(df, amount).alias(name))
    )
    span = sums.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    # One row per month on either side, whatever the size of the source.
    return (
        spine.join(sums, "month", "left")
        .select(month_label(F.col("month")).alias("month"), F.coalesce(F.col(name), F.lit(0)).alias(name))
        .orderBy("month")
    )


def kpis(df: DataFrame) -> DataFrame:
    """Revenue, distinct customers, high-risk rows and churn rate in percent."""
    return df.agg(
        exact_total(df, "total_revenue").alias("total_revenue"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.count_if(F.col("risk_level") == churn.HIGH).alias("high_risk_customers"),
    ).withColumn(
        "churn_rate",
        F.when(F.col("total_customers") > 0, F.col("high_risk_customers") / F.col("total_customers") * 100).otherwise(0.0),
    )


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("customer_id").alias("total_customers"),
        F.count(F.lit(1)).alias("transactions"),
        exact_total(df, "amount").alias("total_revenue"),
        exact_mean(df, "amount").alias("avg_transaction"),
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each numeric column."""
    columns = columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    row = scalars(
        df,
        **{f"{k}_{i}": a for i, c in enumerate(columns)
           for k, a in (("n", F.count(c)), ("mean", F.avg(c)), ("sd", F.stddev_samp(c)),
                        ("lo", F.min(c).cast("double")), ("hi", F.max(c).cast("double")))},
    )
    quarts = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    rows = [
        (c, row[f"n_{i}"], row[f"mean_{i}"], row[f"sd_{i}"], row[f"lo_{i}"], *quarts[c], row[f"hi_{i}"])
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, n long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def run_summary(df: DataFrame, value: str, group: str, names: list[str]) -> DataFrame:
    """Range and mean of a score, and how many rows each group name has."""
    return df.agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.avg(value).alias("mean"),
        *[F.count_if(F.col(group) == n).alias(n.lower().replace(" ", "_")) for n in names],
    )


def zero_prediction_check(df: DataFrame) -> DataFrame:
    """Whether all predictions are 0, with the historic sum and mean beside it."""
    return df.agg(
        exact_total(df, "predicted_revenue").alias("predicted_total"),
        exact_total(df, "total_revenue").alias("historic_total"),
        exact_mean(df, "avg_transaction_value").alias("historic_mean"),
    ).withColumn("all_zero", F.col("predicted_total") == 0)


# --- ranked lists ---------------------------------------------------------------


def top_risk(df: DataFrame, level: str, n: int = 10, p: str = P) -> DataFrame:
    """The most endangered customers of one level."""
    return (
        df.where(F.col("risk_level") == level)
        .orderBy(F.desc(p), "customer_id")
        .select("customer_id", p, "total_amount", "transaction_count")
        .limit(n)
    )


LIST_COLUMNS = ["customer_id", "total_amount", P, "risk_level"]


def retention_list(df: DataFrame, n: int = 3) -> DataFrame:
    """High risk and more money than three quarters of all customers."""
    rows = above_quantile(df, "total_amount").where(F.col("risk_level") == churn.HIGH)
    return rows.orderBy(F.desc(P), "customer_id").select(*LIST_COLUMNS).limit(n)


def upsell_list(df: DataFrame, n: int = 3) -> DataFrame:
    """Low risk and more money than three quarters of all customers."""
    rows = above_quantile(df, "total_amount").where(F.col("risk_level") == churn.LOW)
    return rows.orderBy(F.desc("total_amount"), "customer_id").select(*LIST_COLUMNS).limit(n)


def rising_risk(df: DataFrame, n: int = 3) -> DataFrame:
    rows = df.where(F.col("risk_level") != churn.HIGH)
    return rows.orderBy(F.desc(P), "customer_id").select(*LIST_COLUMNS).limit(n)


def high_value_list(df: DataFrame, n: int = 10) -> DataFrame:
    """Predicted revenue above the upper quartile, with the history columns that exist."""
    rows = above_quantile(df, "predicted_revenue").orderBy(F.desc("predicted_revenue"), "customer_id")
    columns = ["customer_id", "predicted_revenue", "total_revenue", "transaction_count"]
    return rows.select([c for c in columns if c in df.columns]).limit(n)


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of each tenant's latest run; tenants with no run id have none.

    The newest run per tenant is a small combining aggregate joined back, so
    the rows themselves are neither sorted nor grouped by tenant.
    """
    newest = df.groupBy("user_id").agg(F.max("analysis_id").alias("analysis_id"))
    return df.join(newest, ["user_id", "analysis_id"], "left_semi")


def preview(df: DataFrame, order_by: list, n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def newest_per_key(df: DataFrame, key: list[str], order_by: str | None = None) -> DataFrame:
    """The row of each key with the highest ``order_by``: a combining aggregate.

    Ties, and rows without an order, are settled by a hash of the whole row, so
    the choice does not move with partitions.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct().select(*df.columns)
    # A null time is older than any other.
    order = F.struct(*([F.col(order_by).isNotNull(), F.col(order_by)] if order_by else []), F.xxhash64(*rest))
    best = F.max_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*").select(*df.columns)
