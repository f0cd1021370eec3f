"""Cleaning, filters, formatting and screening."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from patronage.functions import scalar
from patronage.operators import cleaning as c
from patronage.operators import screening
from patronage.queries.base import AS_OF, DASHBOARD, ROLLUP, RUNS, TX, CUSTOMERS, customers, dashboard, query, run_tables, table, transactions
from patronage.operators.rollups import customer_rollup
from patronage.queries.sources import CUSTOMER_CSV, TX_CSV, customer_layout, transaction_layout
from patronage.session import scratch_path
from patronage.sources import files


@query(
    "c1_clean_and_join",
    f"""WITH {CUSTOMER_CSV}, {TX_CSV} SELECT t.transaction_id, t.customer_id, t.amount, CAST(t.date AS TIMESTAMP) AS date,
    t.category, c.gender, c.age, upper(trim(c.country)) AS country, CAST(c.signup_date AS TIMESTAMP) AS signup_date
    FROM tx_csv t JOIN customer_csv c USING (customer_id) WHERE t.amount > 0""",
)
def c1(spark, folder):
    left, right = scratch_path(spark, "c1-customers"), scratch_path(spark, "c1-transactions")
    files.write_csv(customer_layout(spark, folder), left)
    files.write_csv(transaction_layout(spark, folder), right)
    out = c.clean_and_join(files.read_customers_csv(spark, left), files.read_transactions_csv(spark, right))
    return out.select("transaction_id", "customer_id", "amount", "date", "category", "gender", "age", "country", "signup_date")


@query(
    "c2_drop_incomplete",
    "SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderstatus <> 'P'",
)
def c2(spark, folder):
    # Pending orders have no amount yet.
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount")
    )
    return c.drop_incomplete(df, ["amount"])


@query("c3_positive_amounts", "SELECT c_custkey, c_acctbal AS amount FROM customer WHERE c_acctbal > 0")
def c3(spark, folder):
    return c.positive_amounts(table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("amount")))


@query(
    "c4_parse_dates",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS date FROM orders",
)
def c4(spark, folder):
    day = F.col("o_orderdate")
    layouts = F.element_at(
        F.array(
            F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "yyyyMMdd"),
            F.date_format(day, "dd MMM yyyy"), F.lit("not a date"),
        ),
        F.substring("o_orderpriority", 1, 1).cast("int"),
    )
    return c.with_dates(table(spark, folder, "orders").select("o_orderkey", layouts.alias("date")), "date")


@query("c5_clean_country", "SELECT c_custkey, upper(trim(c_mktsegment)) AS country FROM customer")
def c5(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("\t ")).alias("country")
    )
    return c.clean_country(df)


@query(
    "c6_parse_numbers",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS amount,
    CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_totalprice END AS frequency FROM orders""",
)
def c6(spark, folder):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("12x")).otherwise(F.col("o_totalprice").cast("string"))
    df = table(spark, folder, "orders").select("o_orderkey", text.alias("amount"), text.alias("frequency"))
    return c.with_numbers(df, {"amount": None, "frequency": 1.0})


@query(
    "c7_days_as_integer",
    f"""WITH {ROLLUP} SELECT customer_id, days_since_last_purchase,
    CASE WHEN transaction_count > 10 THEN 0 ELSE transaction_count END AS other_days FROM rollup""",
)
def c7(spark, folder):
    df = customer_rollup(transactions(spark, folder)).select(
        "customer_id", F.col("last_purchase").alias("days_since_last_purchase"),
        F.when(F.col("transaction_count") > 10, "n/a").otherwise(F.col("transaction_count").cast("string")).alias("other_days"),
    )
    return c.days_as_integer(c.days_as_integer(df, AS_OF), AS_OF, "other_days")


@query("c8_last_activity", f"WITH {ROLLUP} SELECT customer_id, CAST(last_purchase AS DATE) AS last_activity FROM rollup")
def c8(spark, folder):
    return c.last_activity_day(customer_rollup(transactions(spark, folder)).select("customer_id", "last_purchase"))


@query("c9_timestamps_to_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def c9(spark, folder):
    return c.timestamps_to_text(table(spark, folder, "events").select("event_id", "ts"))


@query(
    "c10_fill_nulls",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Unknown' ELSE c_mktsegment END AS country,
    CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS monetary FROM customer""",
)
def c10(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("country"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("monetary"),
    )
    return c.fill_numbers(c.fill_report_nulls(df), ["monetary"])


@query(
    "c11_select_values",
    f"WITH {CUSTOMERS} SELECT customer_id, country, segment FROM customers WHERE country IN ('NATION_3', 'NATION_7', 'NATION_11')",
)
def c11(spark, folder):
    df = customers(spark, folder).select("customer_id", "country", "segment")
    return c.select_values(df, {"country": ["NATION_3", "NATION_7", "NATION_11"], "segment": []})


@query(
    "c12_between_dates",
    f"WITH {TX} SELECT transaction_id, date FROM tx WHERE date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'",
)
def c12(spark, folder):
    df = transactions(spark, folder).select("transaction_id", "date")
    return c.between_dates(df, "date", "1997-01-01", "1998-06-30")


@query("c12_date_bounds", f"WITH {TX} SELECT CAST(min(date) AS DATE) AS first_day, CAST(max(date) AS DATE) AS last_day FROM tx")
def c12_bounds(spark, folder):
    lo, hi = c.date_bounds(transactions(spark, folder), "date", dt.date(2001, 8, 2))
    return spark.createDataFrame([(lo, hi)], "first_day date, last_day date")


@query("c13_for_tenant", f"WITH {RUNS} SELECT * FROM churn WHERE user_id = 'MACHINERY'")
def c13(spark, folder):
    return c.for_tenant(run_tables(spark, folder)["churn"], "MACHINERY")


@query("c14_filter_options", f"WITH {DASHBOARD} SELECT DISTINCT country FROM dashboard ORDER BY country")
def c14(spark, folder):
    return c.filter_options(dashboard(spark, folder), "country")


@query(
    "c15_display_formats",
    f"""WITH {RUNS} SELECT customer_id, analysis_id, format('{{:.1f}}%', churn_probability * 100) AS churn_probability_text,
    '$' || format('{{:,.2f}}', total_amount) AS total_amount_text, strftime(last_activity, '%Y-%m') AS month FROM churn""",
)
def c15(spark, folder):
    df = c.display_formats(run_tables(spark, folder)["churn"], ["churn_probability"], ["total_amount"])
    return df.select(
        "customer_id", "analysis_id", "churn_probability_text", "total_amount_text",
        scalar.month_label(F.col("last_activity")).alias("month"),
    )


def _screen_sql(source, key, column):
    words = "|".join(screening.KEYWORDS)
    danger = ("(?i)" + "|".join(screening.PATTERNS)).replace("'", "''")
    blanks = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
    return f"""WITH t AS (SELECT {key}, trim({column}, {blanks}) AS s FROM {source}),
    f AS (SELECT *, regexp_matches(upper(s), '{words}') AS has_keyword, regexp_matches(s, '{danger}') AS has_pattern,
      length(s) > 50 AS too_long, regexp_matches(s, '{screening.EMAIL}') AS is_email FROM t)
    SELECT {key}, has_keyword, has_pattern, too_long, is_email, CASE WHEN has_keyword OR has_pattern OR too_long
      OR NOT is_email THEN '' ELSE s END AS safe_text FROM f"""


@query("c16_screen_documents", _screen_sql("documents", "doc_id", "text"))
def c16(spark, folder):
    return screening.screen_text(table(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")


@query("c16_screen_addresses", _screen_sql("(SELECT c_custkey, lower(c_name) || '@shop.eu' AS name FROM customer)", "c_custkey", "name"))
def c16_addresses(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", F.concat(F.lower("c_name"), F.lit("@shop.eu")).alias("name"))
    return screening.screen_text(df, "name").drop("name")
