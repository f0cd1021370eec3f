"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import joins as j
from patronage.operators.rollups import customer_rollup, revenue_metrics
from patronage.queries.base import (
    CUSTOMERS, DASHBOARD, RUNS, TX, catalogued_runs, customers, dashboard, query, rounded, run_tables, table, transactions,
)

PAIR = "t.transaction_id, t.customer_id, t.amount, c.customer_name, c.country"


def people(spark, folder):
    return customers(spark, folder).select("customer_id", "customer_name", "country")


def amounts(spark, folder):
    return transactions(spark, folder).select("transaction_id", "customer_id", "amount")


@query("j1_inner_many_to_one", f"WITH {TX}, {CUSTOMERS} SELECT {PAIR} FROM tx t JOIN customers c USING (customer_id)")
def j1(spark, folder):
    return j.join_one(amounts(spark, folder), people(spark, folder), validate=True)


@query(
    "j2_left_transactions",
    f"""WITH {TX}, {CUSTOMERS} SELECT {PAIR} FROM tx t LEFT JOIN customers c USING (customer_id)""",
)
def j2(spark, folder):
    return j.join_one(amounts(spark, folder), people(spark, folder), how="left")


METRICS = """m AS (SELECT customer_id, fsum(amount) AS total_revenue, fsum(amount) / count(amount) AS avg_revenue, count(amount) AS transaction_count
  FROM tx GROUP BY customer_id)"""


@query(
    "j3_attach_metrics",
    f"""WITH {TX}, {CUSTOMERS}, {METRICS} SELECT c.customer_id, c.customer_name, round(coalesce(total_revenue, 0), 2) AS total_revenue,
    round(coalesce(avg_revenue, 0), 6) AS avg_revenue, coalesce(transaction_count, 0) AS transaction_count
    FROM customers c LEFT JOIN m USING (customer_id)""",
)
def j3(spark, folder):
    metrics = revenue_metrics(transactions(spark, folder)).select("customer_id", "total_revenue", "avg_revenue", "transaction_count")
    out = j.attach_metrics(customers(spark, folder).select("customer_id", "customer_name"), metrics)
    return rounded(out, total_revenue=2, avg_revenue=6)


@query(
    "j4_customers_to_transactions",
    f"""WITH {TX}, {CUSTOMERS} SELECT c.customer_id, c.country, t.transaction_id, t.amount FROM customers c
    LEFT JOIN tx t USING (customer_id)""",
)
def j4(spark, folder):
    return j.one_to_many(customers(spark, folder).select("customer_id", "country"), amounts(spark, folder))


@query(
    "j5_last_purchase",
    f"""WITH {TX} SELECT customer_id, round(sum(amount), 2) AS total_amount, count(amount) AS transaction_count,
    max(date) AS last_purchase FROM tx GROUP BY customer_id""",
)
def j5(spark, folder):
    return rounded(customer_rollup(transactions(spark, folder)), total_amount=2)


DAYS = "CAST(floor(amount / 100000) AS BIGINT)"


@query(
    "j6_fan_out_pairs",
    f"""WITH {TX}, pairs AS (SELECT DISTINCT customer_id, {DAYS} AS days_since_last_purchase FROM tx),
    m AS (SELECT customer_id, count(amount) AS transaction_count FROM tx GROUP BY customer_id)
    SELECT customer_id, transaction_count, days_since_last_purchase FROM m LEFT JOIN pairs USING (customer_id)""",
)
def j6(spark, folder):
    # A few different values per customer, so that the join fans out.
    t = transactions(spark, folder).withColumn("days_since_last_purchase", F.floor(F.col("amount") / 100000))
    metrics = t.groupBy("customer_id").agg(F.count("amount").alias("transaction_count"))
    return j.attach_pairs(metrics, t, "days_since_last_purchase")


@query(
    "j7_first_demographics",
    f"""WITH {TX}, f AS (SELECT customer_id, arg_min(category, (date, transaction_id)) AS category FROM tx GROUP BY customer_id),
    m AS (SELECT customer_id, count(amount) AS transaction_count FROM tx GROUP BY customer_id)
    SELECT customer_id, transaction_count, category FROM m LEFT JOIN f USING (customer_id)""",
)
def j7(spark, folder):
    out = customer_rollup(transactions(spark, folder), None, ["category"], ["date", "transaction_id"])
    return out.select("customer_id", "transaction_count", "category")


@query("j8_dashboard_join", f"WITH {DASHBOARD} SELECT * FROM dashboard")
def j8(spark, folder):
    """The dashboard over tables that lie bucket beside bucket."""
    return catalogued_runs(spark, folder).dashboard()


@query("j8_dashboard_shuffled", f"WITH {DASHBOARD} SELECT * FROM dashboard")
def j8_shuffled(spark, folder):
    """The same over tables of any layout."""
    return dashboard(spark, folder)


@query(
    "j8_dashboard_inner",
    f"""WITH {RUNS} SELECT c.customer_id, c.age, c.gender, c.country, c.total_spent, c.transaction_count,
    c.first_purchase_date, c.last_purchase_date, x.risk_level, x.churn_probability, r.revenue_segment, r.predicted_revenue,
    h.analysis_id, h.user_id, h.timestamp AS analysis_date FROM people c
    LEFT JOIN churn x USING (user_id, analysis_id, customer_id) LEFT JOIN revenue r USING (user_id, analysis_id, customer_id)
    JOIN history h ON h.user_id = c.user_id AND h.analysis_id = c.analysis_id""",
)
def j8_inner(spark, folder):
    t = run_tables(spark, folder, segments=True)
    return j.dashboard_join_inner(t["customers"], t["history"], t["churn"], t["revenue"])


@query(
    "j9_lookup_count",
    f"""WITH {CUSTOMERS}, e AS (SELECT user_id AS customer_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT customer_id, coalesce(clicks, 0) AS clicks FROM customers LEFT JOIN e USING (customer_id)""",
)
def j9(spark, folder):
    e = table(spark, folder, "events").where("event_type = 'click'").select(F.col("user_id").alias("customer_id"))
    return j.lookup_count(customers(spark, folder).select("customer_id"), e, "clicks")


@query(
    "j10_owned_children",
    f"WITH {RUNS} SELECT c.* FROM churn c SEMI JOIN history h USING (user_id, analysis_id) WHERE analysis_id = 1999 AND user_id = 'FURNITURE'",
)
def j10(spark, folder):
    t = run_tables(spark, folder)
    return j.owned_children(t["churn"], t["history"], "FURNITURE", 1999)


@query(
    "j11_cascade_delete",
    f"WITH {RUNS} SELECT c.* FROM revenue0 c ANTI JOIN (SELECT * FROM history WHERE analysis_id < 1997) h USING (user_id, analysis_id)",
)
def j11(spark, folder):
    t = run_tables(spark, folder)
    return j.without_runs(t["revenue"], t["history"].where("analysis_id < 1997"), ["user_id", "analysis_id"])
