"""Sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from patronage.operators import cleaning
from patronage.queries.base import (
    AS_OF, CHURN, CUSTOMERS, DASHBOARD, REVENUE, ROLLUP, RUNS, TX, catalogued_runs, customers, query, run_tables, scored, segmented,
    transactions,
)
from patronage.session import scratch_path
from patronage.sources import files, store

AT = dt.datetime(2001, 8, 2, 12, 0, 0)


def customer_layout(spark, folder):
    """Customers in the typed CSV layout; the account balance stands in for the age."""
    c = customers(spark, folder)
    return c.select(
        "customer_id", F.lit(None).cast("string").alias("gender"), F.floor(F.abs("balance") / 100).cast("long").alias("age"),
        "country", F.lit("1995-01-01").alias("signup_date"),
    )


def transaction_layout(spark, folder):
    t = transactions(spark, folder)
    return t.select(
        F.col("transaction_id").cast("string"), "customer_id", "amount", F.date_format("date", "yyyy-MM-dd").alias("date"),
        "category",
    )


CUSTOMER_CSV = f"""{CUSTOMERS}, customer_csv AS (SELECT customer_id, CAST(NULL AS VARCHAR) AS gender,
  CAST(floor(abs(balance) / 100) AS BIGINT) AS age, country, '1995-01-01' AS signup_date FROM customers)"""
TX_CSV = f"""{TX}, tx_csv AS (SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, customer_id, amount,
  strftime(date, '%Y-%m-%d') AS date, category FROM tx)"""


def write_then(spark, df, reader, tag):
    path = scratch_path(spark, tag)
    files.write_csv(df, path)
    return reader(spark, path)


@query("s1_customers_csv", f"WITH {CUSTOMER_CSV} SELECT * FROM customer_csv")
def s1(spark, folder):
    return write_then(spark, customer_layout(spark, folder), files.read_customers_csv, "customers-csv")


@query("s2_transactions_csv", f"WITH {TX_CSV} SELECT * FROM tx_csv")
def s2(spark, folder):
    return write_then(spark, transaction_layout(spark, folder), files.read_transactions_csv, "transactions-csv")


@query("s3_inferred_csv", f"WITH {TX} SELECT transaction_id, customer_id, date, amount, category FROM tx")
def s3(spark, folder):
    df = write_then(spark, transactions(spark, folder), files.read_csv, "inferred-csv")
    return df.select(
        F.col("transaction_id").cast("long"), F.col("customer_id").cast("long"), F.col("date").cast("timestamp_ntz"),
        "amount", "category",
    )


@query("s4_empty_guard", f"WITH {TX} SELECT count(*) AS kept FROM tx WHERE amount > 0")
def s4(spark, folder):
    t = transactions(spark, folder)
    cleaning.require_rows(t, customers(spark, folder))
    return cleaning.positive_amounts(t).agg(F.count(F.lit(1)).alias("kept"))


def customer_master(spark, folder):
    from patronage.operators.rollups import customer_rollup

    t = transactions(spark, folder)
    rolled = customer_rollup(t, AS_OF, ["category"], ["date", "transaction_id"], first_date=True)
    return rolled.select(
        "customer_id", F.col("first_purchase").alias("first_purchase_date"), F.col("last_purchase").alias("last_purchase_date"),
        F.col("transaction_count").alias("total_orders"), F.round("total_amount", 2).alias("total_spend"),
        F.round(F.col("total_amount") / F.col("transaction_count"), 6).alias("avg_order_value"), "days_since_last_purchase",
        F.col("category").alias("preferred_category"), (F.col("days_since_last_purchase") <= 365).alias("is_active"),
    )


MASTER = f"""{ROLLUP}, firsts AS (SELECT customer_id, arg_min(category, (date, transaction_id)) AS preferred_category
  FROM tx GROUP BY customer_id),
master AS (SELECT customer_id, first_purchase AS first_purchase_date, last_purchase AS last_purchase_date,
  transaction_count AS total_orders, round(total_amount, 2) AS total_spend,
  round(total_amount / transaction_count, 6) AS avg_order_value, days_since_last_purchase, preferred_category,
  days_since_last_purchase <= 365 AS is_active FROM rollup JOIN firsts USING (customer_id))"""


@query("s5_active_customers", f"WITH {MASTER} SELECT * EXCLUDE (is_active) FROM master WHERE is_active")
def s5(spark, folder):
    return files.active_customers(customer_master(spark, folder))


@query(
    "s6_transactions_since",
    f"""WITH {TX} SELECT customer_id, date AS transaction_date, amount, category, 'unknown' AS payment_method
    FROM tx WHERE date >= TIMESTAMP '2000-01-01'""",
)
def s6(spark, folder):
    t = transactions(spark, folder).select(
        "customer_id", F.col("date").alias("transaction_date"), "amount", "category", F.lit("unknown").alias("payment_method")
    )
    return files.transactions_since(t, dt.datetime(2000, 1, 1))


@query("s7_tenant_scan", f"WITH {RUNS} SELECT * FROM churn WHERE user_id = 'BUILDING'")
def s7(spark, folder):
    path = scratch_path(spark, "tenant-scan")
    churn = run_tables(spark, folder)["churn"]
    # Rebalancing gives each run its own few files and splits a run that is too big for one.
    churn.hint("rebalance", "user_id", "analysis_id").write.partitionBy("user_id", "analysis_id").parquet(path)
    return cleaning.for_tenant(spark.read.schema(churn.schema).parquet(path), "BUILDING")


@query("s8_csv_sink", f"WITH {TX} SELECT count(*) AS row_count, round(sum(amount), 2) AS total FROM tx")
def s8(spark, folder):
    df = write_then(spark, transactions(spark, folder), files.read_csv, "csv-sink")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("amount"), 2).alias("total"))


def rule_run(spark, folder):
    """Churn, revenue and customer rows of one run over all customers."""
    churn = scored(spark, folder)
    revenue = segmented(spark, folder).select(
        "customer_id", F.col("target_revenue").alias("predicted_revenue"), F.col("monetary").alias("total_revenue"),
        "revenue_segment", F.col("frequency").alias("transaction_count"), F.col("avg_order_value").alias("avg_transaction_value"),
    )
    people = customers(spark, folder).join(
        churn.select("customer_id", F.col("total_amount").alias("total_spent"), "transaction_count",
                     F.col("last_purchase").alias("last_purchase_date")),
        "customer_id",
    )
    return churn, revenue, people


def stored_run(spark, folder):
    runs = store.RunStore(spark, scratch_path(spark, "run-store"))
    return runs, runs.save_run("tenant@example.com", *rule_run(spark, folder), at=AT)


RULE_RUN = f"""churn AS (WITH {CHURN} SELECT * FROM risk), revenue AS (WITH {REVENUE} SELECT * FROM segmented)"""


@query(
    "s9_append_results",
    f"""WITH {RULE_RUN} SELECT 'tenant@example.com' AS user_id, (SELECT count(*) FROM churn) AS churn_rows,
    (SELECT count(*) FROM revenue) AS revenue_rows""",
)
def s9(spark, folder):
    runs = store.RunStore(spark, scratch_path(spark, "append"))
    churn, revenue, _ = rule_run(spark, folder)
    runs.append_results("tenant@example.com", 1, churn, revenue, AS_OF)
    c = runs.table("churn_data").groupBy("user_id").agg(F.count(F.lit(1)).alias("churn_rows"))
    r = runs.table("revenue_data").groupBy("user_id").agg(F.count(F.lit(1)).alias("revenue_rows"))
    return c.join(r, "user_id")


@query(
    "s10_save_run",
    f"""WITH {RULE_RUN}, c AS (SELECT CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (p > 0.5) AS INTEGER) AS high FROM churn),
    r AS (SELECT CAST(CAST(sum(target_revenue) AS DECIMAL(15,2)) AS DOUBLE) AS total,
      CAST(CAST(avg(target_revenue) AS DECIMAL(15,2)) AS DOUBLE) AS mean FROM revenue)
    SELECT TIMESTAMP '2001-08-02 12:00:00' AS timestamp, n AS total_customers, high AS high_risk_customers,
    total AS total_predicted_revenue, mean AS avg_predicted_revenue,
    format('Analysis completed for {{}} customers.', n) AS analysis_summary FROM c, r""",
)
def s10(spark, folder):
    runs, _ = stored_run(spark, folder)
    return runs.history("tenant@example.com").drop("analysis_id")


@query(
    "s11_reload_run",
    f"""WITH {RULE_RUN} SELECT CAST(customer_id AS VARCHAR) AS customer_id, CAST(CAST(p AS DECIMAL(5,4)) AS DOUBLE) AS churn_probability,
    risk_level, CAST(CAST(total_amount AS DECIMAL(15,2)) AS DOUBLE) AS total_amount,
    CAST(transaction_count AS INTEGER) AS transaction_count, CAST(days_since_last_purchase AS INTEGER) AS days_since_last_purchase,
    CAST(last_purchase AS DATE) AS last_activity, 'tenant@example.com' AS user_id FROM churn""",
)
def s11(spark, folder):
    runs, run = stored_run(spark, folder)
    rows = runs.run_rows("churn_data", "tenant@example.com", run).drop("analysis_id")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("churn_probability", "total_amount")})


@query(
    "s12_dashboard_view",
    f"""WITH {DASHBOARD} SELECT country, count(*) AS row_count, round(sum(total_revenue), 2) AS total_revenue
    FROM dashboard GROUP BY country""",
)
def s12(spark, folder):
    """The permanent view of the catalog, read by SQL."""
    view = catalogued_runs(spark, folder).name("full_dashboard_data")
    return spark.sql(f"SELECT country, count(*) AS row_count, round(sum(total_revenue), 2) AS total_revenue FROM {view} GROUP BY country")


@query("s13_table_exists", "SELECT true AS dashboard, true AS churn, false AS other")
def s13_exists(spark, folder):
    runs = catalogued_runs(spark, folder)
    found = [runs.exists(t) for t in ("full_dashboard_data", "churn_data", "no_such_table")]
    return spark.createDataFrame([tuple(found)], "dashboard boolean, churn boolean, other boolean")


LISTED = [
    ("analysis_id", "bigint"), ("user_id", "string"), ("customer_id", "string"), ("customer_name", "string"), ("age", "int"), ("gender", "string"),
    ("country", "string"), ("total_revenue", "double"), ("predicted_revenue", "double"), ("churn_probability", "double"), ("risk_level", "string"),
    ("revenue_segment", "string"), ("transaction_count", "bigint"), ("avg_transaction_value", "double"), ("first_purchase_date", "date"),
    ("last_purchase_date", "date"), ("days_since_last_purchase", "bigint"), ("created_at", "timestamp_ntz"),
]


@query(
    "s13_table_schema",
    "SELECT CAST(place AS INTEGER) AS place, column_name, data_type FROM (VALUES " + ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(LISTED))
    + ") v(place, column_name, data_type)",
)
def s13_schema(spark, folder):
    """Columns of the dashboard view as the catalog lists them."""
    return catalogued_runs(spark, folder).columns("full_dashboard_data")


@query(
    "s13_first_rows",
    f"WITH {DASHBOARD} SELECT * FROM dashboard ORDER BY analysis_id, user_id, customer_id LIMIT 5",
)
def s13_first(spark, folder):
    return catalogued_runs(spark, folder).first_rows("full_dashboard_data", ["analysis_id", "user_id", "customer_id"], 5)


@query(
    "s13_tenants",
    f"WITH {DASHBOARD} SELECT count(*) AS row_count, count(DISTINCT user_id) AS tenants FROM dashboard",
)
def s13_tenants(spark, folder):
    return store.profile(catalogued_runs(spark, folder).table("full_dashboard_data"))


@query(
    "s13_profile",
    f"""WITH {RUNS} SELECT count(*) AS row_count, count(DISTINCT user_id) AS tenants FROM people""",
)
def s13(spark, folder):
    return store.profile(run_tables(spark, folder)["customers"])


@query(
    "s13_recent_runs",
    f"""WITH {RUNS} SELECT user_id, analysis_id, timestamp FROM history
    ORDER BY timestamp DESC, analysis_id DESC, user_id LIMIT 5""",
)
def s13_recent(spark, folder):
    return store.recent_runs(run_tables(spark, folder)["history"])
