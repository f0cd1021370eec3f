"""Scoring and labelling rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import churn as c
from patronage.operators import features, revenue
from patronage.operators.rollups import customer_rollup
from patronage.plans.analysis import segment_customers
from patronage.queries.base import (
    AS_OF, CHURN, CUSTOMERS, REVENUE, customers, query, rounded, scored, segmented, table, transactions,
)


@query("r1_risk_levels", f"WITH {CHURN} SELECT customer_id, risk_level FROM risk")
def r1(spark, folder):
    return scored(spark, folder).select("customer_id", "risk_level")


@query(
    "r2_small_risk_levels",
    """WITH n AS (SELECT r_name, row_number() OVER (ORDER BY sum(c_acctbal) DESC, r_name) AS place, count(*) OVER () AS n
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
    SELECT r_name AS customer_id, CASE WHEN place = 1 THEN 'High Risk' WHEN place <= greatest(2, CASE WHEN n > 3
      THEN ceil(n * 0.3) ELSE 2 END) THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level FROM n""",
)
def r2(spark, folder):
    # One row per region: the small table this rule is for, drawn from all customers.
    per = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey")
        .agg(F.sum("c_acctbal").alias("churn_probability_final"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("customer_id"), "churn_probability_final")
    )
    return c.risk_levels(per).select("customer_id", "risk_level")


@query(
    "r3_fixed_relabel",
    f"""WITH {CHURN} SELECT customer_id, CASE WHEN p >= 0.4e0 THEN 'High Risk' WHEN p >= 0.2e0 THEN 'Medium Risk'
    ELSE 'Low Risk' END AS risk_level FROM risk""",
)
def r3(spark, folder):
    return c.relabel_if_weak(scored(spark, folder), accuracy=0.4).select("customer_id", "risk_level")


@query("r4_churn_probability", f"WITH {CHURN} SELECT customer_id, round(p, 6) AS churn_probability FROM scored")
def r4(spark, folder):
    df = features.rfm_features(customer_rollup(transactions(spark, folder), AS_OF), AS_OF)
    return rounded(c.churn_probability(df).select("customer_id", "churn_probability"), churn_probability=6)


@query("r4_noisy_probability")
def r4_noise(spark, folder):
    df = features.rfm_features(customer_rollup(transactions(spark, folder), AS_OF), AS_OF)
    return c.churn_probability(df, noise=c.NOISE_SD).select("customer_id", "churn_probability")


@query("r5_initial_label", f"WITH {CHURN} SELECT customer_id, first_label AS churn_label FROM risk")
def r5(spark, folder):
    return c.initial_label(scored(spark, folder)).select("customer_id", "churn_label")


# Labels from a cut that leaves too many churned customers, so that balancing acts.
MANY = f"""{CHURN}, many AS (SELECT customer_id, p, CASE WHEN p > 0.3e0 THEN 1 ELSE 0 END AS label FROM risk),
sizes AS (SELECT count(*) AS n, sum(label) AS churned, greatest(2, CAST(floor(count(*) * 0.05e0) AS BIGINT)) AS m,
  CAST(floor(count(*) * 0.25e0) AS BIGINT) AS target FROM many),
job AS (SELECT CASE WHEN churned < m THEN m - churned WHEN n - churned < m THEN churned - (n - m)
  WHEN churned > target * 1.5 THEN churned - target ELSE 0 END AS k, CASE WHEN churned < m THEN 1 ELSE 0 END AS v FROM sizes)"""


def many_churned(spark, folder):
    df = scored(spark, folder).select("customer_id", "churn_probability")
    return df.withColumn("churn_label", (F.col("churn_probability") > 0.3).cast("int"))


@query(
    "r6_balance_as_written",
    f"""WITH {MANY}, ranked AS (SELECT many.*, row_number() OVER (ORDER BY p, customer_id) AS low,
      row_number() OVER (ORDER BY p DESC, customer_id) AS top FROM many)
    SELECT customer_id, CASE WHEN v = 1 AND top <= k THEN 1 WHEN v = 0 AND low <= k THEN 0 ELSE label END AS churn_label
    FROM ranked, job""",
)
def r6(spark, folder):
    return c.balance_labels(many_churned(spark, folder)).select("customer_id", "churn_label")


@query(
    "r6_balance_intended",
    f"""WITH {MANY}, ranked AS (SELECT many.*, row_number() OVER (PARTITION BY label ORDER BY p, customer_id) AS low,
      row_number() OVER (PARTITION BY label ORDER BY p DESC, customer_id) AS top FROM many)
    SELECT customer_id, CASE WHEN v = 1 AND label = 0 AND top <= k THEN 1 WHEN v = 0 AND label = 1 AND low <= k THEN 0
    ELSE label END AS churn_label FROM ranked, job""",
)
def r6_intended(spark, folder):
    return c.balance_labels(many_churned(spark, folder), "intended").select("customer_id", "churn_label")


@query(
    "r7_both_classes",
    f"""WITH {CHURN}, best AS (SELECT customer_id FROM risk ORDER BY p DESC, customer_id LIMIT 1)
    SELECT r.customer_id, CASE WHEN b.customer_id IS NULL THEN 0 ELSE 1 END AS churn_label
    FROM risk r LEFT JOIN best b USING (customer_id)""",
)
def r7(spark, folder):
    nobody = scored(spark, folder).withColumn("churn_label", F.lit(0))
    return c.ensure_both_classes(nobody).select("customer_id", "churn_label")


@query("r8_revenue_target", f"WITH {REVENUE} SELECT customer_id, target_revenue FROM target")
def r8(spark, folder):
    df = features.rfm_features(customer_rollup(transactions(spark, folder), AS_OF), AS_OF, "revenue")
    return revenue.revenue_target(df).select("customer_id", "target_revenue")


@query("r8_noisy_target")
def r8_noise(spark, folder):
    df = features.rfm_features(customer_rollup(transactions(spark, folder), AS_OF), AS_OF, "revenue")
    return revenue.revenue_target(df, noise=revenue.NOISE_SD).select("customer_id", "target_revenue")


@query("r9_drop_null_targets", "SELECT c_custkey AS customer_id, c_acctbal AS target_revenue FROM customer WHERE c_acctbal > 0")
def r9(spark, folder):
    target = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    df = table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), target.alias("target_revenue"))
    return revenue.drop_null_targets(df)


@query("r9_no_targets", f"WITH {CUSTOMERS} SELECT customer_id, CAST(0 AS DOUBLE) AS predicted_revenue, 'Medium Value' AS revenue_segment FROM customers")
def r9_none(spark, folder):
    return revenue.no_prediction(customers(spark, folder).select("customer_id"))


@query("r10_value_segments", f"WITH {REVENUE} SELECT customer_id, revenue_segment FROM segmented")
def r10(spark, folder):
    return segment_customers(transactions(spark, folder), AS_OF).select("customer_id", "revenue_segment")


@query(
    "r11_result_columns",
    f"""WITH {REVENUE} SELECT customer_id, round(monetary, 2) AS total_revenue, frequency AS transaction_count,
    round(avg_order_value, 6) AS avg_transaction_value FROM segmented""",
)
def r11(spark, folder):
    out = revenue.result_columns(segmented(spark, folder))
    out = out.select("customer_id", "total_revenue", "transaction_count", "avg_transaction_value")
    return rounded(out, total_revenue=2, avg_transaction_value=6)


@query(
    "r12_neutral_features",
    f"WITH {CUSTOMERS} SELECT customer_id, CAST(0 AS BIGINT) AS recency_days, CAST(1 AS BIGINT) AS frequency, CAST(1 AS DOUBLE) AS monetary, 0 AS rfm_score FROM customers",
)
def r12(spark, folder):
    return features.rfm_features(customers(spark, folder).select("customer_id"), AS_OF, on_missing="neutral")
