"""Column recognition, renaming and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import mapping as m
from patronage.queries.base import CUSTOMERS, DASHBOARD, RUNS, TX, customers, dashboard, query, run_tables, table, transactions

KINDS = {"long": "int", "int": "int", "double": "float", "string": "text", "timestamp": "time"}


def _like(words, name="column_name"):
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


def _probe(table_name, column, kind):
    number = f"TRY_CAST({column} AS DOUBLE)" if kind != "time" else "CAST(NULL AS DOUBLE)"
    dates = f"count({column})" if kind != "text" else f"count(TRY_CAST({column} AS TIMESTAMP))"
    return f"""SELECT '{column}' AS column_name, '{kind}' AS kind, count({column}) AS non_null,
  count(DISTINCT {column}) AS uniq, count({number}) AS numbers, {dates} AS dates, min({number}) AS low,
  max({number}) AS high, count(*) FILTER ({number} BETWEEN 15 AND 100) AS ages,
  count(*) FILTER (lower(CAST({column} AS VARCHAR)) IN ('m', 'f', 'male', 'female')) AS genders FROM {table_name}"""


def types_sql(probes):
    """The recognition rules over one probe row per column."""
    return f"""probes AS ({' UNION ALL '.join(probes)}),
typed AS (SELECT column_name, non_null, numbers, low, high, CASE
  WHEN {_like(m.ID_WORDS)} AND uniq > non_null * 0.8 THEN 'customer_id'
  WHEN {_like(m.DATE_WORDS)} AND dates = non_null THEN 'date'
  WHEN {_like(m.AMOUNT_WORDS)} AND numbers > 0 THEN 'amount'
  WHEN {_like(m.NAME_WORDS)} THEN 'customer_name' WHEN {_like(m.PLACE_WORDS)} THEN 'location'
  WHEN {_like(m.CATEGORY_WORDS)} THEN 'category'
  WHEN {_like(m.AGE_WORDS)} AND ages > 0 THEN 'age' WHEN {_like(m.GENDER_WORDS)} AND genders > 0 THEN 'gender'
  WHEN kind IN ('int', 'float') THEN CASE WHEN low > 0 AND high < 1000000 THEN 'amount' ELSE 'numeric' END
  WHEN kind = 'time' THEN 'date' WHEN uniq < non_null * 0.3 THEN 'category'
  WHEN uniq > non_null * 0.8 THEN 'customer_id' ELSE 'unknown' END AS semantic_type FROM probes)"""


ORDERS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "float"),
          ("o_orderdate", "time"), ("o_orderpriority", "text")]
PART = [("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "int"),
        ("p_retailprice", "float")]
CUSTOMER = [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "text")]


@query("m1_column_types_orders", f"WITH {types_sql([_probe('orders', c, k) for c, k in ORDERS])} SELECT * FROM typed")
def m1(spark, folder):
    df = table(spark, folder, "orders")
    return m.describe_types(df, m.column_stats(df))


@query("m1_column_types_part", f"WITH {types_sql([_probe('part', c, k) for c, k in PART])} SELECT * FROM typed")
def m1_part(spark, folder):
    df = table(spark, folder, "part")
    return m.describe_types(df, m.column_stats(df))


@query(
    "m2_sampled_types",
    "WITH " + types_sql([
        _probe(f"(SELECT {c} FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 100)", c, k) for c, k in CUSTOMER
    ]) + " SELECT * FROM typed",
)
def m2(spark, folder):
    # The first hundred values of each column are what this operator looks at.
    df = table(spark, folder, "customer")
    return m.describe_types(df, m.sample_stats(df, "c_custkey"))


def _first_rows(c):
    return f"(SELECT {c} FROM orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 100)"


PLACE = "list_position([" + ", ".join(f"'{c}'" for c, _ in ORDERS) + "], column_name)"


def _pick(role, fallback="false"):
    return f"""SELECT '{role}' AS role, coalesce((SELECT arg_min(column_name, {PLACE}) FROM heads WHERE semantic_type = '{role}'),
    (SELECT arg_min(column_name, {PLACE}) FROM wholes WHERE {fallback})) AS column_name"""


MAP_SQL = (
    f"WITH heads AS (WITH {types_sql([_probe(_first_rows(c), c, k) for c, k in ORDERS])} SELECT * FROM typed), "
    f"wholes AS (SELECT *, (SELECT count(*) FROM orders) AS n FROM ({' UNION ALL '.join(_probe('orders', c, k) for c, k in ORDERS)})) "
    + " UNION ALL ".join([
        _pick("customer_id", "uniq > n * 0.8"), _pick("date", "dates = non_null"), _pick("amount", "numbers > 0 AND low > 0"),
        *[_pick(r) for r in m.ROLES[3:]],
    ])
)


@query("m3_auto_map", MAP_SQL)
def m3(spark, folder):
    chosen = m.auto_map(table(spark, folder, "orders"), "o_orderkey")
    return spark.createDataFrame(list(chosen.items()), "role string, column_name string")


@query("m4_rename_roles", "SELECT o_custkey AS customer_id, o_orderdate AS date, o_totalprice AS amount, o_orderkey FROM orders")
def m4(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return m.rename_roles(df, {"customer_id": "o_custkey", "date": "o_orderdate", "amount": "o_totalprice", "age": None})


@query("m5_alias_columns", "SELECT o_custkey AS client_id, o_totalprice AS price, o_totalprice AS amount, o_custkey AS customer_id FROM orders")
def m5(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_custkey").alias("client_id"), F.col("o_totalprice").alias("price"))
    return m.alias_columns(df)


@query(
    "m6_default_columns",
    f"""WITH {CUSTOMERS} SELECT customer_id, country, CAST(NULL AS VARCHAR) AS customer_name, CAST(NULL AS INTEGER) AS age,
    CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS location, 'General' AS category FROM customers""",
)
def m6(spark, folder):
    return m.transaction_defaults(m.customer_defaults(customers(spark, folder).select("customer_id", "country")))


@query(
    "m7_ids_by_position",
    """WITH ids AS (SELECT o_custkey AS customer_id, row_number() OVER (ORDER BY min(o_orderdate), o_custkey) - 1 AS i
      FROM orders GROUP BY o_custkey),
    people AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS i FROM customer)
    SELECT c_name, customer_id FROM people LEFT JOIN ids USING (i)""",
)
def m7(spark, folder):
    people = table(spark, folder, "customer").select("c_name")
    return m.ids_by_position(people, [F.col("c_name")], transactions(spark, folder), "date").select("c_name", "customer_id")


@query(
    "m8_positional_defaults",
    """SELECT o_orderkey, o_totalprice, o_orderkey AS amount, CAST(TIMESTAMP '2020-01-01' + to_days(CAST(
    row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER)) AS TIMESTAMP) AS date FROM orders""",
)
def m8(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return m.amount_from_first_number(m.dates_by_position(df, [F.col("o_orderkey")]))


WIDE = f"""{CUSTOMERS}, {TX}, wide AS (SELECT tx.*, customer_name, country FROM tx LEFT JOIN customers USING (customer_id))"""


def wide(spark, folder):
    c = customers(spark, folder).select("customer_id", "customer_name", "country")
    return transactions(spark, folder).join(c, "customer_id", "left")


@query(
    "m9_split_wide",
    f"""WITH {WIDE}, c AS (SELECT customer_id, arg_min(customer_name, (date, transaction_id)) AS customer_name,
      arg_min(country, (date, transaction_id)) AS country FROM wide GROUP BY customer_id)
    SELECT transaction_id, customer_id, date, amount, category, customer_name, country FROM tx LEFT JOIN c USING (customer_id)""",
)
def m9(spark, folder):
    _, _, merged = m.split_wide(wide(spark, folder), ["date", "transaction_id"])
    return merged.select("transaction_id", "customer_id", "date", "amount", "category", "customer_name", "country")


@query("m10_number_customers", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS customer_id FROM customer")
def m10(spark, folder):
    return m.number_customers(table(spark, folder, "customer").select("c_name"), [F.col("c_name")]).select("c_name", "customer_id")


@query("m11_stamp_run", f"WITH {TX} SELECT customer_id, amount, 'tenant@example.com' AS user_id, 7 AS analysis_id FROM tx")
def m11(spark, folder):
    return m.stamp_run(transactions(spark, folder).select("customer_id", "amount"), "tenant@example.com", 7)


@query("m12_keep_columns", f"WITH {RUNS} SELECT user_id, analysis_id, customer_id, churn_probability, risk_level, total_amount, transaction_count, days_since_last_purchase, last_activity FROM churn")
def m12(spark, folder):
    churn = run_tables(spark, folder)["churn"].withColumn("note", F.lit("x"))
    return m.keep_columns(churn, m.CHURN_COLUMNS)


@query("m13_strip_names", f"WITH {TX} SELECT customer_id, amount FROM tx")
def m13(spark, folder):
    return m.strip_names(transactions(spark, folder).select(F.col("customer_id").alias(" customer_id "), F.col("amount").alias("amount  ")))


@query(
    "m14_report_columns",
    f"""WITH {RUNS} SELECT customer_id, risk_level, 'Unknown' AS country, 'Unknown' AS gender, 'Unknown' AS revenue_segment,
    0 AS total_revenue FROM churn""",
)
def m14(spark, folder):
    return m.report_columns(run_tables(spark, folder)["churn"].select("customer_id", "risk_level"))


@query(
    "m15_final_probability",
    f"""WITH {RUNS} SELECT customer_id, analysis_id, round(churn_probability / 2, 8) AS churn_probability_final,
    round(churn_probability / 2, 8) AS churn_probability FROM churn""",
)
def m15(spark, folder):
    churn = run_tables(spark, folder)["churn"]
    df = churn.withColumn("churn_probability_final", F.round(F.col("churn_probability") / 2, 8))
    return m.prefer_final_probability(df).select("customer_id", "analysis_id", "churn_probability_final", "churn_probability")


@query(
    "m16_date_columns",
    "SELECT o_orderdate, o_orderdate AS last_seen_text, o_orderkey AS total_orders FROM orders",
)
def m16(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy").alias("last_seen_text"), F.col("o_orderkey").alias("total_orders")
    )
    return m.parse_date_columns(df)


@query("m17_currency", "SELECT '€' AS sign, count(*) AS row_count FROM orders")
def m17(spark, folder):
    # The first twenty amounts are what this operator looks at.
    df = transactions(spark, folder).withColumn("amount", F.concat(F.lit("€ "), F.col("amount").cast("string")))
    sign = m.currency_sign(df, "transaction_id")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(sign).alias("sign"), "row_count")


@query(
    "m18_completeness",
    f"""WITH {DASHBOARD} SELECT count(country) AS country_rows, count(gender) AS gender_rows,
    count(last_purchase_date) AS last_purchase_date_rows, count(total_revenue) AS total_revenue_rows,
    count(country) > 0 AND count(gender) > 0 AND count(last_purchase_date) > 0 AND count(total_revenue) > 0 AS complete
    FROM dashboard""",
)
def m18(spark, folder):
    return m.completeness(dashboard(spark, folder))
