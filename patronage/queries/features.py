"""Customer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import features as f
from patronage.operators.rollups import customer_rollup
from patronage.queries.base import AS_OF, EVENTS_AS_OF, REVENUE, RFM_CHURN, RFM_REVENUE, ROLLUP, query, rounded, table, transactions


def rolled(spark, folder, first=False):
    return customer_rollup(transactions(spark, folder), AS_OF, first_date=first)


@query("f1_recency", f"WITH {ROLLUP} SELECT customer_id, days_since_last_purchase AS recency_days FROM rollup")
def f1(spark, folder):
    df = rolled(spark, folder).withColumnRenamed("last_purchase", "last_purchase_date")
    return f.with_recency(df, AS_OF).select("customer_id", "recency_days")


@query("f2_frequency", f"WITH {ROLLUP} SELECT customer_id, transaction_count AS frequency FROM rollup")
def f2(spark, folder):
    return f.with_frequency(rolled(spark, folder)).select("customer_id", "frequency")


@query("f3_monetary", f"WITH {ROLLUP} SELECT customer_id, round(total_amount, 2) AS monetary FROM rollup")
def f3(spark, folder):
    return rounded(f.with_monetary(rolled(spark, folder), "revenue").select("customer_id", "monetary"), monetary=2)


CODES = "customer_id, recency_days, frequency, round(monetary, 2) AS monetary, recency_score, frequency_score, monetary_score, rfm_score"
NAMES = ["customer_id", "recency_days", "frequency", "monetary", "recency_score", "frequency_score", "monetary_score", "rfm_score"]


@query("f4_churn_rfm", f"WITH {RFM_CHURN} SELECT {CODES} FROM rfm")
def f4(spark, folder):
    return rounded(f.rfm_features(rolled(spark, folder), AS_OF, "churn").select(*NAMES), monetary=2)


@query("f5_revenue_rfm", f"WITH {RFM_REVENUE} SELECT {CODES} FROM rfm")
def f5(spark, folder):
    return rounded(f.rfm_features(rolled(spark, folder), AS_OF, "revenue").select(*NAMES), monetary=2)


@query(
    "f6_tenure_from_dates",
    f"""WITH {ROLLUP}, t AS (SELECT customer_id, CAST(transaction_count AS DOUBLE) AS frequency,
      CAST(floor(epoch(last_purchase - first_purchase) / 86400) AS DOUBLE) AS customer_tenure FROM rollup)
    SELECT customer_id, customer_tenure, round(frequency / greatest(customer_tenure, 1), 9) AS purchase_velocity FROM t""",
)
def f6(spark, folder):
    df = rolled(spark, folder, True).withColumnsRenamed({"first_purchase": "first_purchase_date", "last_purchase": "last_purchase_date"})
    out = f.tenure_features(f.rfm_inputs(df, AS_OF))
    return rounded(out.select("customer_id", "customer_tenure", "purchase_velocity"), purchase_velocity=9)


ESTIMATED = f"""{ROLLUP}, t AS (SELECT customer_id, CAST(transaction_count AS DOUBLE) AS frequency,
  CAST(days_since_last_purchase AS DOUBLE) + transaction_count * 30 AS customer_tenure FROM rollup)"""


@query("f6_tenure_estimated", f"WITH {ESTIMATED} SELECT customer_id, customer_tenure, round(frequency / greatest(customer_tenure, 1), 9) AS purchase_velocity FROM t")
def f6_estimated(spark, folder):
    out = f.tenure_features(f.rfm_inputs(rolled(spark, folder), AS_OF))
    return rounded(out.select("customer_id", "customer_tenure", "purchase_velocity"), purchase_velocity=9)


@query(
    "f7_recent_activity",
    f"""WITH e AS (SELECT user_id AS customer_id, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) AS a,
      count(*) AS b FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 60 DAY GROUP BY 1)
    SELECT c_custkey AS customer_id, coalesce(a, 0) AS recent_activity_30d, coalesce(b, 0) AS recent_activity_60d
    FROM customer LEFT JOIN e ON c_custkey = customer_id""",
)
def f7(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("transaction_date"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"))
    return f.activity_features(c, e, EVENTS_AS_OF)


@query("f8_frequency_trend", f"WITH {ESTIMATED} SELECT customer_id, round(frequency / greatest(customer_tenure, 1), 9) AS frequency_trend FROM t")
def f8(spark, folder):
    out = f.tenure_features(f.rfm_inputs(rolled(spark, folder), AS_OF))
    return rounded(out.select("customer_id", "frequency_trend"), frequency_trend=9)


def valued(spark, folder):
    return f.value_features(f.rfm_inputs(rolled(spark, folder), AS_OF, "revenue"))


def _value_query(name, column):
    # Plain arithmetic on exact sums: both engines give the same bits, so nothing is rounded.
    @query(name, f"WITH {REVENUE} SELECT customer_id, {column} FROM target")
    def run(spark, folder):
        return valued(spark, folder).select("customer_id", column)


_value_query("f9_order_value", "avg_order_value")
_value_query("f10_purchase_frequency", "purchase_frequency")
_value_query("f11_lifetime_months", "customer_lifetime_months")
_value_query("f12_revenue_velocity", "revenue_velocity")
_value_query("f12_spending_growth", "spending_growth")


@query(
    "f13_feature_matrix",
    f"""WITH {REVENUE} SELECT customer_id, CAST(recency_days AS DOUBLE) AS recency_days,
    CAST(frequency AS DOUBLE) AS frequency, monetary, CAST(rfm_score AS DOUBLE) AS rfm_score, revenue_velocity FROM target""",
)
def f13(spark, folder):
    df = f.value_features(f.rfm_features(rolled(spark, folder), AS_OF, "revenue"))
    out, _ = f.feature_matrix(df, f.REVENUE_FEATURES, None)
    return out.select("customer_id", "recency_days", "frequency", "monetary", "rfm_score", "revenue_velocity")
