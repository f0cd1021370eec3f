"""Registry of queries and the roles the test tables play.

``query`` stores a callable ``(spark, folder) -> DataFrame`` under a name, with
the SQL text that must give the same rows. SQL texts start from the shared
``WITH`` parts below, which state the same roles.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.functions.scalar import whole_days
from patronage.functions.sums import exact_total
from patronage.operators.churn import WEIGHTS, fixed_risk_levels
from patronage.operators.joins import dashboard_join
from patronage.operators.revenue import value_segments
from patronage.operators.runs import run_totals
from patronage.plans.analysis import score_customers, segment_customers
from patronage.session import materialize_once, scratch_root
from patronage.sources.catalog import VIEW, RunCatalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), d) for c, d in digits.items()})


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("category"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )


TX = """tx AS (SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS date,
  o_totalprice AS amount, o_orderpriority AS category FROM orders)"""
CUSTOMERS = """customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name, n_name AS country,
  c_mktsegment AS segment, c_acctbal AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
ROLLUP = f"""{TX}, rollup AS (SELECT customer_id, coalesce(fsum(amount), 0e0) AS total_amount,
  count(amount) AS transaction_count, min(date) AS first_purchase, max(date) AS last_purchase,
  CAST(floor(epoch(TIMESTAMP '{AS_OF}' - max(date)) / 86400) AS BIGINT) AS days_since_last_purchase
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


def edges_sql(column: str, source: str) -> str:
    return f"(SELECT list_sort(list_distinct(quantile_cont({column}, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) FROM {source})"


def code_sql(column: str, edges: str) -> str:
    """Quintile code of ``column`` against the edge list."""
    return (
        f"CASE WHEN {column} IS NULL OR len({edges}) < 2 THEN NULL ELSE CAST(coalesce(list_sum(list_transform("
        f"{edges}[2:len({edges})-1], lambda e: CASE WHEN {column} > e THEN 1 ELSE 0 END)), 0) AS INTEGER) END"
    )


def rfm_sql(recency_score: str) -> str:
    return f"""{ROLLUP}, metrics AS (SELECT *, days_since_last_purchase AS recency_days, transaction_count AS frequency,
  total_amount AS monetary FROM rollup),
edges AS (SELECT {edges_sql('recency_days', 'metrics')} AS re, {edges_sql('frequency', 'metrics')} AS fe,
  {edges_sql('monetary', 'metrics')} AS me),
coded AS (SELECT metrics.*, {code_sql('recency_days', 're')} AS r, {code_sql('frequency', 'fe')} AS frequency_score,
  {code_sql('monetary', 'me')} AS monetary_score FROM metrics, edges),
rfm AS (SELECT *, {recency_score} AS recency_score, {recency_score} + frequency_score + monetary_score AS rfm_score FROM coded)"""


RFM_CHURN = rfm_sql("r")
RFM_REVENUE = rfm_sql("4 - r")

# Rule-based probability, label and risk level of every customer.
CHURN = f"""{RFM_CHURN}, tops AS (SELECT max(recency_days) AS xr, max(frequency) AS xf, max(monetary) AS xm,
  max(rfm_score) AS xs FROM rfm),
scored AS (SELECT rfm.*, greatest(0, least(1, 0.35e0 * recency_days / xr + 0.30e0 * (1 - frequency / xf)
  + 0.25e0 * (1 - monetary / xm) + 0.10e0 * (1 - rfm_score / xs))) AS p FROM rfm, tops),
ordered AS (SELECT p, row_number() OVER (ORDER BY p) AS place, count(*) OVER () AS n FROM scored),
cuts AS (SELECT max(CASE WHEN place = CAST(floor(n * 0.9e0) AS BIGINT) + 1 THEN p END) AS hi,
  max(CASE WHEN place = CAST(floor(n * 0.7e0) AS BIGINT) + 1 THEN p END) AS mid FROM ordered),
risk AS (SELECT scored.*, CASE WHEN p > 0.6e0 THEN 1 ELSE 0 END AS first_label,
  CASE WHEN p >= hi THEN 'High Risk' WHEN p >= mid THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level
  FROM scored, cuts)"""

# Revenue features, target and segment of every customer.
REVENUE = f"""{RFM_REVENUE}, valued AS (SELECT *, monetary / greatest(frequency, 1) AS avg_order_value,
  frequency / greatest(recency_days, 1) * 365 AS purchase_frequency, greatest(recency_days / 30, 1) AS customer_lifetime_months,
  monetary / greatest(recency_days, 1) AS revenue_velocity FROM rfm),
span AS (SELECT min(frequency) AS flo, max(frequency) AS fhi FROM valued),
target AS (SELECT valued.*, avg_order_value * purchase_frequency AS spending_growth, greatest(0, monetary
  * (1 + (frequency - flo) / (fhi - flo + 1)) * (1 + recency_score / 4.0e0) * (1 + rfm_score / 15.0e0)) AS target_revenue
  FROM valued, span),
seg_cuts AS (SELECT quantile_cont(target_revenue, 0.33) AS lo, quantile_cont(target_revenue, 0.67) AS hi FROM target),
segmented AS (SELECT target.*, CASE WHEN target_revenue >= hi THEN 'High Value' WHEN target_revenue >= lo
  THEN 'Medium Value' ELSE 'Low Value' END AS revenue_segment FROM target, seg_cuts)"""


# --- stored runs: tenant = market segment, run = order year ----------------------


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per tenant, run and customer, with the run's own maxima joined on."""
    o, c = transactions(spark, folder), customers(spark, folder)
    # Orders shrink to one row per run and customer before they meet the customers.
    per = o.groupBy("customer_id", F.year("date").cast("long").alias("analysis_id")).agg(
        exact_total(o, "amount").alias("total_amount"), F.count("amount").alias("transaction_count"),
        F.min("date").alias("first_purchase"), F.max("date").alias("last_purchase"),
    )
    per = per.join(c, "customer_id").withColumn("days_since_last_purchase", whole_days(F.col("last_purchase"), AS_OF))
    return per.select(
        F.col("segment").alias("user_id"), "analysis_id", F.col("customer_id").cast("string").alias("customer_id"),
        "customer_name", "country", "total_amount", "transaction_count", "first_purchase", "last_purchase",
        "days_since_last_purchase",
    )


def run_tables(spark: SparkSession, folder: str, segments: bool = False) -> dict[str, DataFrame]:
    """History, churn, revenue and customer tables of all tenants and runs."""
    key = ["user_id", "analysis_id"]

    def make():
        rows = run_rows(spark, folder)
        tops = rows.groupBy(*key).agg(
            F.max("days_since_last_purchase").alias("xr"), F.max("transaction_count").alias("xf"),
            F.min("transaction_count").alias("nf"), F.max("total_amount").alias("xm"),
        )
        return rows.join(tops, key)

    # One written table feeds every result, as the stored tables of a run would; it is written once per session.
    wide = materialize_once(spark, f"run-rows-{zlib.crc32(folder.encode()):08x}", make)
    p = (
        F.lit(WEIGHTS["recency_days"]) * F.col("days_since_last_purchase") / F.col("xr")
        + F.lit(WEIGHTS["frequency"]) * (1 - F.col("transaction_count") / F.col("xf"))
        + F.lit(WEIGHTS["monetary"]) * (1 - F.col("total_amount") / F.col("xm"))
    )
    churn = wide.withColumn("churn_probability", F.round(p, 6)).select(
        *key, "customer_id", "churn_probability", "total_amount", "transaction_count",
        "days_since_last_purchase", F.to_date("last_purchase").alias("last_activity"),
    )
    churn = fixed_risk_levels(churn, "churn_probability")
    lift = 1 + (F.col("transaction_count") - F.col("nf")) / (F.col("xf") - F.col("nf") + 1)
    revenue = wide.select(
        *key, "customer_id", (F.col("total_amount") * lift).alias("predicted_revenue"),
        F.col("total_amount").alias("total_revenue"), "transaction_count",
        (F.col("total_amount") / F.col("transaction_count")).alias("avg_transaction_value"),
    )
    if segments:
        revenue = value_segments(revenue)
    people = wide.select(
        *key, "customer_id", "customer_name", F.lit(None).cast("int").alias("age"),
        F.lit(None).cast("string").alias("gender"), "country", F.col("total_amount").alias("total_spent"),
        "transaction_count", F.to_date("first_purchase").alias("first_purchase_date"),
        F.to_date("last_purchase").alias("last_purchase_date"),
    )
    stamps = wide.groupBy(*key).agg(F.max("last_purchase").alias("timestamp"))
    history = run_totals(churn, revenue).join(stamps, key)
    history = rounded(history, total_predicted_revenue=4, avg_predicted_revenue=4)
    return {"history": history, "churn": churn, "revenue": revenue, "customers": people}


RUNS = f"""{CUSTOMERS}, per AS (SELECT o_custkey AS customer_id, CAST(year(o_orderdate) AS BIGINT) AS analysis_id,
  fsum(o_totalprice) AS total_amount, count(o_totalprice) AS transaction_count, min(o_orderdate) AS first_purchase,
  max(o_orderdate) AS last_purchase FROM orders GROUP BY 1, 2),
run_rows AS (SELECT segment AS user_id, analysis_id, CAST(customer_id AS VARCHAR) AS customer_id, customer_name, country,
  total_amount, transaction_count, first_purchase, last_purchase,
  CAST(floor(epoch(TIMESTAMP '{AS_OF}' - last_purchase) / 86400) AS BIGINT) AS days_since_last_purchase
  FROM per JOIN customers USING (customer_id)),
tops AS (SELECT user_id, analysis_id, max(days_since_last_purchase) AS xr, max(transaction_count) AS xf,
  min(transaction_count) AS nf, max(total_amount) AS xm FROM run_rows GROUP BY 1, 2),
churn0 AS (SELECT user_id, analysis_id, customer_id, round(0.35e0 * days_since_last_purchase / xr
  + 0.30e0 * (1 - transaction_count / xf) + 0.25e0 * (1 - total_amount / xm), 6) AS churn_probability,
  total_amount, transaction_count, days_since_last_purchase,
  CAST(last_purchase AS DATE) AS last_activity FROM run_rows JOIN tops USING (user_id, analysis_id)),
churn AS (SELECT *, CASE WHEN churn_probability >= 0.4e0 THEN 'High Risk' WHEN churn_probability >= 0.2e0
  THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level FROM churn0),
revenue0 AS (SELECT user_id, analysis_id, customer_id, total_amount
  * (1 + (transaction_count - nf) / (xf - nf + 1)) AS predicted_revenue, total_amount AS total_revenue,
  transaction_count, total_amount / transaction_count AS avg_transaction_value
  FROM run_rows JOIN tops USING (user_id, analysis_id)),
rev_cuts AS (SELECT quantile_cont(predicted_revenue, 0.33) AS lo, quantile_cont(predicted_revenue, 0.67) AS hi FROM revenue0),
revenue AS (SELECT revenue0.*, CASE WHEN predicted_revenue >= hi THEN 'High Value' WHEN predicted_revenue >= lo
  THEN 'Medium Value' ELSE 'Low Value' END AS revenue_segment FROM revenue0, rev_cuts),
people AS (SELECT user_id, analysis_id, customer_id, customer_name, CAST(NULL AS INTEGER) AS age,
  CAST(NULL AS VARCHAR) AS gender, country, total_amount AS total_spent, transaction_count,
  CAST(first_purchase AS DATE) AS first_purchase_date, CAST(last_purchase AS DATE) AS last_purchase_date FROM run_rows),
churn_runs AS (SELECT user_id, analysis_id, count(*) AS total_customers,
  count(*) FILTER (churn_probability > 0.5) AS high_risk_customers FROM churn GROUP BY 1, 2),
revenue_runs AS (SELECT user_id, analysis_id, round(sum(predicted_revenue), 4) AS total_predicted_revenue,
  round(avg(predicted_revenue), 4) AS avg_predicted_revenue FROM revenue0 GROUP BY 1, 2),
stamps AS (SELECT user_id, analysis_id, max(last_purchase) AS timestamp FROM run_rows GROUP BY 1, 2),
history AS (SELECT c.*, r.total_predicted_revenue, r.avg_predicted_revenue,
  format('Analysis completed for {{}} customers.', c.total_customers) AS analysis_summary, s.timestamp
  FROM churn_runs c JOIN revenue_runs r USING (user_id, analysis_id) JOIN stamps s USING (user_id, analysis_id))"""

DASHBOARD = f"""{RUNS}, dashboard AS (SELECT c.analysis_id, c.user_id, c.customer_id, c.customer_name, c.age, c.gender,
  c.country, r.total_revenue, r.predicted_revenue, x.churn_probability, x.risk_level, r.revenue_segment,
  c.transaction_count, r.avg_transaction_value, c.first_purchase_date, c.last_purchase_date,
  x.days_since_last_purchase, h.timestamp AS created_at FROM people c
  LEFT JOIN history h ON c.analysis_id = h.analysis_id AND c.user_id = h.user_id
  LEFT JOIN churn x ON c.analysis_id = x.analysis_id AND c.customer_id = x.customer_id
  LEFT JOIN revenue r ON c.analysis_id = r.analysis_id AND c.customer_id = r.customer_id)"""


def catalogued_runs(spark: SparkSession, folder: str) -> RunCatalog:
    """All runs of all tenants as tables of the catalog with the dashboard view, made once per session."""
    mark = f"{zlib.crc32(f'{spark.sparkContext.applicationId} {folder}'.encode()):08x}"
    runs = RunCatalog(spark, f"runs_{mark}", f"{scratch_root(spark)}/catalog-{mark}", buckets=8)
    if not runs.exists(VIEW):
        t = run_tables(spark, folder, segments=True)
        runs.append({"customer_data": t["customers"], "churn_data": t["churn"], "revenue_data": t["revenue"], "analysis_history": t["history"]})
        runs.create_view()
    return runs


def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    t = run_tables(spark, folder, segments=True)
    return dashboard_join(t["customers"], t["history"], t["churn"], t["revenue"])


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Rule-scored customers with the column names of a finished churn run."""
    df = score_customers(transactions(spark, folder), AS_OF)
    return df.withColumn("churn_probability_final", F.col("churn_probability"))


def segmented(spark: SparkSession, folder: str) -> DataFrame:
    return segment_customers(transactions(spark, folder), AS_OF)
