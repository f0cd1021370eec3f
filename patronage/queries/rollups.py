"""Rollups and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import reports as r
from patronage.operators import rollups as u
from patronage.operators.selection import scalars
from patronage.plans.analysis import churn_run_summary, revenue_run_summary
from patronage.queries.base import (
    AS_OF, CHURN, CUSTOMERS, DASHBOARD, EVENTS_AS_OF, REVENUE, ROLLUP, RUNS, TX, customers, dashboard, query, rounded,
    run_tables, scored, segmented, table, transactions,
)


@query("a1_customer_rollup", f"WITH {ROLLUP} SELECT customer_id, round(total_amount, 2) AS total_amount, transaction_count FROM rollup")
def a1(spark, folder):
    out = u.customer_rollup(transactions(spark, folder).drop("date"))
    return rounded(out, total_amount=2)


# Amounts of every size: a customer in seven also has infinities, one in five missing numbers (NaN).
EXTREMES = """spread AS (SELECT o_custkey AS customer_id, CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'inf'::DOUBLE
  WHEN o_custkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 1e28
  WHEN o_orderkey % 4 = 1 THEN -o_totalprice * 1e-35 ELSE o_totalprice END AS amount FROM orders),
  finite AS (SELECT customer_id, fsum(amount) FILTER (isfinite(amount)) AS total, count(*) FILTER (isinf(amount)) AS endless,
  count(*) FILTER (NOT isnan(amount)) AS transaction_count FROM spread GROUP BY customer_id)"""


@query(
    "a1_extreme_amounts",
    f"""WITH {EXTREMES} SELECT customer_id, transaction_count, endless > 0 AS endless,
    CASE WHEN endless = 0 THEN printf('%.9e', coalesce(total, 0e0)) END AS total_amount FROM finite""",
)
def a1_extremes(spark, folder):
    """Rollup of amounts between 1e-35 and 1e33 with infinities and NaN among them."""
    key, order, price = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")
    amount = (
        F.when((key % 7 == 0) & (order % 5 == 0), float("inf")).when((key % 5 == 0) & (order % 3 == 0), float("nan"))
        .when(order % 4 == 0, price * 1e28).when(order % 4 == 1, -price * 1e-35).otherwise(price)
    )
    spread = table(spark, folder, "orders").select(key.alias("customer_id"), amount.alias("amount"))
    endless = F.col("total_amount") == float("inf")
    return u.customer_rollup(spread).select(
        "customer_id", "transaction_count", endless.alias("endless"), F.when(~endless, F.format_string("%.9e", "total_amount")).alias("total_amount")
    )


@query("a2_last_purchase_age", f"WITH {ROLLUP} SELECT customer_id, last_purchase, days_since_last_purchase FROM rollup")
def a2(spark, folder):
    return u.customer_rollup(transactions(spark, folder), AS_OF).select("customer_id", "last_purchase", "days_since_last_purchase")


FIVE = f"""WITH {TX}, m AS (SELECT customer_id, fsum(amount) AS total_revenue, fsum(amount) / count(amount) AS avg_revenue,
  count(amount) AS transaction_count, min(date) AS first_purchase, max(date) AS last_purchase FROM tx GROUP BY customer_id)"""


@query(
    "a3_five_way_rollup",
    f"""{FIVE} SELECT customer_id, round(total_revenue, 2) AS total_revenue, round(avg_revenue, 6) AS avg_revenue,
    transaction_count, first_purchase, last_purchase FROM m""",
)
def a3(spark, folder):
    return rounded(u.revenue_metrics(transactions(spark, folder)), total_revenue=2, avg_revenue=6).drop("customer_lifetime_value")


@query("a4_lifetime_value", f"{FIVE} SELECT customer_id, round(total_revenue * transaction_count, 2) AS customer_lifetime_value FROM m")
def a4(spark, folder):
    out = u.revenue_metrics(transactions(spark, folder)).select("customer_id", "customer_lifetime_value")
    return rounded(out, customer_lifetime_value=2)


@query(
    "a5_prepare_from_transactions",
    f"""WITH {ROLLUP} SELECT customer_id, round(total_amount, 2) AS total_amount, transaction_count, last_purchase,
    days_since_last_purchase FROM rollup""",
)
def a5(spark, folder):
    return rounded(u.prepare_features(transactions(spark, folder), AS_OF), total_amount=2)


@query(
    "a5_prepare_from_customers",
    f"WITH {ROLLUP} SELECT customer_id, round(total_amount, 2) AS total_amount, transaction_count, days_since_last_purchase FROM rollup",
)
def a5_customers(spark, folder):
    rolled = u.customer_rollup(transactions(spark, folder), AS_OF).withColumnsRenamed({"customer_id": "client_id", "transaction_count": "purchases"})
    return rounded(u.prepare_features(rolled, AS_OF), total_amount=2)


@query(
    "a5_prepare_without_metrics",
    f"""WITH {CUSTOMERS} SELECT customer_id, country, 0 AS total_amount, 0 AS transaction_count, 0 AS days_since_last_purchase
    FROM customers""",
)
def a5_missing(spark, folder):
    return u.prepare_features(customers(spark, folder).select("customer_id", "country"), AS_OF)


@query(
    "a6_recent_activity",
    f"""SELECT user_id AS customer_id,
    count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) AS recent_activity_30d, count(*) AS recent_activity_60d
    FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 60 DAY GROUP BY user_id""",
)
def a6(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("customer_id"), F.col("ts").alias("transaction_date"))
    return u.recent_activity(e, EVENTS_AS_OF)


@query(
    "a7_risk_levels_in_order",
    f"""WITH {CHURN}, levels AS (SELECT * FROM (VALUES (0, 'High Risk'), (1, 'Medium Risk'), (2, 'Low Risk')) v(place, risk_level))
    SELECT place, l.risk_level, count(r.customer_id) AS customers FROM levels l LEFT JOIN risk r USING (risk_level)
    GROUP BY 1, 2 ORDER BY place""",
)
def a7(spark, folder):
    return r.risk_level_counts(scored(spark, folder))


@query("a8_risk_level_counts", f'WITH {DASHBOARD} SELECT risk_level, count(*) AS "count" FROM dashboard GROUP BY risk_level')
def a8(spark, folder):
    return r.value_counts(dashboard(spark, folder), "risk_level")


@query("a9_segment_counts", f'WITH {REVENUE} SELECT revenue_segment, count(*) AS "count" FROM segmented GROUP BY revenue_segment')
def a9(spark, folder):
    return r.value_counts(segmented(spark, folder), "revenue_segment")


@query(
    "a10_revenue_by_segment",
    f"WITH {DASHBOARD} SELECT revenue_segment, round(sum(total_revenue), 2) AS total_revenue FROM dashboard GROUP BY revenue_segment",
)
def a10(spark, folder):
    return rounded(r.sum_by(dashboard(spark, folder), "revenue_segment", "total_revenue", "total_revenue"), total_revenue=2)


@query(
    "a11_monthly_revenue",
    f"""WITH {TX}, m AS (SELECT date_trunc('month', date) AS month, sum(amount) AS v FROM tx GROUP BY 1),
    spine AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month)
    SELECT strftime(spine.month, '%Y-%m') AS month, round(coalesce(v, 0), 2) AS total_revenue
    FROM spine LEFT JOIN m ON m.month = spine.month ORDER BY 1""",
)
def a11(spark, folder):
    return rounded(r.monthly_totals(transactions(spark, folder), "date", "amount", "total_revenue"), total_revenue=2)


def sales_by_country(spark, folder):
    """Orders shrink to one row per customer before they meet the countries."""
    per = u.customer_rollup(transactions(spark, folder).drop("date"))
    return per.join(customers(spark, folder).select("customer_id", "country"), "customer_id")


@query(
    "a12_country_top10",
    f"""WITH {ROLLUP}, {CUSTOMERS} SELECT country, round(sum(total_amount), 2) AS total_revenue
    FROM rollup JOIN customers USING (customer_id) GROUP BY country ORDER BY sum(total_amount) DESC, country LIMIT 10""",
)
def a12(spark, folder):
    return rounded(r.top_by_sum(sales_by_country(spark, folder), "country", "total_amount", "total_revenue"), total_revenue=2)


@query(
    "a13_kpis",
    f"""WITH {DASHBOARD} SELECT round(sum(total_revenue), 2) AS total_revenue, count(DISTINCT customer_id) AS total_customers,
    count(*) FILTER (risk_level = 'High Risk') AS high_risk_customers,
    round(count(*) FILTER (risk_level = 'High Risk') / count(DISTINCT customer_id) * 100, 6) AS churn_rate FROM dashboard""",
)
def a13(spark, folder):
    return rounded(r.kpis(dashboard(spark, folder)), total_revenue=2, churn_rate=6)


@query(
    "a14_overview",
    f"""WITH {TX} SELECT count(DISTINCT customer_id) AS total_customers, count(*) AS transactions,
    round(sum(amount), 2) AS total_revenue, round(avg(amount), 4) AS avg_transaction FROM tx""",
)
def a14(spark, folder):
    return rounded(r.overview(transactions(spark, folder)), total_revenue=2, avg_transaction=4)


def _summary(c):
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50,
  CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lines"""


@query(
    "a15_numeric_summary",
    "WITH lines AS (SELECT l_quantity, l_extendedprice, l_linenumber FROM lineitem) "
    + " UNION ALL ".join(_summary(c) for c in ("l_quantity", "l_extendedprice", "l_linenumber")),
)
def a15(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_linenumber")
    return rounded(r.numeric_summary(df), mean=4, std=4)


@query("a16_label_histogram", 'SELECT quality AS churn_label, count(*) AS "count" FROM labels GROUP BY quality')
def a16(spark, folder):
    return r.value_counts(table(spark, folder, "labels").select(F.col("quality").alias("churn_label")), "churn_label")


@query("a17_global_scalars", f"WITH {ROLLUP} SELECT max(days_since_last_purchase) AS top_recency, min(transaction_count) AS low_frequency, max(transaction_count) AS top_frequency, count(*) AS row_count FROM rollup")
def a17(spark, folder):
    s = scalars(
        u.customer_rollup(transactions(spark, folder), AS_OF), top_recency=F.max("days_since_last_purchase"),
        low_frequency=F.min("transaction_count"), top_frequency=F.max("transaction_count"), row_count=F.count(F.lit(1)),
    )
    return spark.createDataFrame([tuple(s.values())], ", ".join(f"{n} long" for n in s))


@query("a18_grain_test", f"WITH {TX} SELECT count(*) = count(DISTINCT customer_id) AS one_row_per_customer FROM tx")
def a18(spark, folder):
    one = u.one_row_per_customer(transactions(spark, folder))
    return spark.createDataFrame([(one,)], "one_row_per_customer boolean")


@query(
    "a19_churn_run_summary",
    f"""WITH {CHURN} SELECT round(min(p), 6) AS low, round(max(p), 6) AS high, round(avg(p), 6) AS mean,
    count(*) FILTER (risk_level = 'High Risk') AS high_risk, count(*) FILTER (risk_level = 'Medium Risk') AS medium_risk,
    count(*) FILTER (risk_level = 'Low Risk') AS low_risk FROM risk""",
)
def a19(spark, folder):
    return rounded(churn_run_summary(scored(spark, folder)), low=6, high=6, mean=6)


@query(
    "a19_revenue_run_summary",
    f"""WITH {REVENUE} SELECT round(min(target_revenue), 4) AS low, round(max(target_revenue), 4) AS high,
    round(avg(target_revenue), 4) AS mean, count(*) FILTER (revenue_segment = 'High Value') AS high_value,
    count(*) FILTER (revenue_segment = 'Medium Value') AS medium_value,
    count(*) FILTER (revenue_segment = 'Low Value') AS low_value FROM segmented""",
)
def a19_revenue(spark, folder):
    df = segmented(spark, folder).withColumn("predicted_revenue", F.col("target_revenue"))
    return rounded(revenue_run_summary(df), low=4, high=4, mean=4)


@query(
    "a20_zero_prediction_check",
    f"""WITH {RUNS} SELECT round(sum(predicted_revenue), 2) AS predicted_total, round(sum(total_revenue), 2) AS historic_total,
    round(avg(avg_transaction_value), 4) AS historic_mean, sum(predicted_revenue) = 0 AS all_zero FROM revenue0""",
)
def a20(spark, folder):
    df = r.zero_prediction_check(run_tables(spark, folder)["revenue"])
    return rounded(df, predicted_total=2, historic_total=2, historic_mean=4)
