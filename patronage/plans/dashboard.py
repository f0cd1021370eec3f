"""The dashboard of one tenant: latest run, filters, tiles and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.operators import cleaning, mapping, reports


def latest_rows(view: DataFrame, users: DataFrame, user_id: str) -> DataFrame:
    """The tenant's newest run; no rows for an unknown tenant.

    The tenant filter reaches the scans under the view, and the newest run is
    found there too instead of fetching every run.
    """
    known = users.where(F.col("email") == F.lit(user_id)).select(F.col("email").alias("user_id"))
    mine = view.where(F.col("user_id") == F.lit(user_id)).join(known, "user_id", "left_semi")
    return reports.latest_run(mine)


def prepare(rows: DataFrame) -> DataFrame:
    """Dates parsed, empty dimensions named."""
    return cleaning.fill_report_nulls(mapping.parse_date_columns(rows))


def filtered(
    rows: DataFrame, country=None, gender=None, segment=None, start=None, end=None, keep_null_dates: bool = False, today=None
) -> DataFrame:
    """The rows the chosen filters leave; the date range defaults to what is there."""
    rows = cleaning.select_values(rows, {"country": country, "gender": gender, "revenue_segment": segment})
    if start is None or end is None:
        lo, hi = cleaning.date_bounds(rows, "last_purchase_date", today)
        start, end = start or lo, end or hi
    return cleaning.between_dates(rows, "last_purchase_date", start, end, keep_null_dates)


def charts(rows: DataFrame) -> dict[str, DataFrame]:
    return {
        "kpis": reports.kpis(rows),
        "risk_levels": reports.value_counts(rows, "risk_level"),
        "revenue_by_segment": reports.sum_by(rows, "revenue_segment", "total_revenue", "total_revenue"),
        "revenue_by_month": reports.monthly_totals(rows, "last_purchase_date", "total_revenue", "total_revenue"),
        "top_countries": reports.top_by_sum(rows, "country", "total_revenue", "total_revenue"),
    }
