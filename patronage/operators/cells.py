"""Additive totals of a run: the dashboard reads them instead of the run's customers.

A cell holds the customers of a run who agree in country, gender, value
segment, risk level and day of the last purchase: how many they are and what
they spent. Every tile and chart, and every filter of the dashboard, is a sum
over cells or a choice among them, so a dashboard's cost no longer grows with
the number of customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.functions.sums import exact_total
from patronage.operators import churn, reports
from patronage.operators.joins import RUN_KEY

DIMENSIONS = ["country", "gender", "revenue_segment", "risk_level", "last_purchase_date"]


def run_cells(rows: DataFrame) -> DataFrame:
    """Cells of dashboard rows, of one run or of many; ``rows`` has a customer once per run."""
    key = [*RUN_KEY, *(F.to_date(c).alias(c) if c == "last_purchase_date" else F.col(c) for c in DIMENSIONS)]
    return rows.groupBy(*key).agg(F.count("customer_id").alias("customers"), exact_total(rows, "total_revenue").cast("double").alias("total_revenue"))


def charts(cells: DataFrame) -> dict[str, DataFrame]:
    """The tiles and charts of the dashboard from the cells that its filters left."""
    high = F.sum(F.when(F.col("risk_level") == churn.HIGH, F.col("customers")).otherwise(0))
    kpis = cells.agg(
        exact_total(cells, "total_revenue").alias("total_revenue"), F.coalesce(F.sum("customers"), F.lit(0)).alias("total_customers"),
        F.coalesce(high, F.lit(0)).alias("high_risk_customers"),
    )
    rate = F.when(F.col("total_customers") > 0, F.col("high_risk_customers") / F.col("total_customers") * 100).otherwise(0.0)
    levels = cells.where("risk_level is not null").groupBy("risk_level").agg(F.sum("customers").alias("count"))
    return {
        "kpis": kpis.withColumn("churn_rate", rate),
        "risk_levels": levels.orderBy(F.desc("count"), "risk_level"),
        "revenue_by_segment": reports.sum_by(cells, "revenue_segment", "total_revenue", "total_revenue"),
        "revenue_by_month": reports.monthly_totals(cells, "last_purchase_date", "total_revenue", "total_revenue"),
        "top_countries": reports.top_by_sum(cells, "country", "total_revenue", "total_revenue"),
    }
