"""Quantile codes, thresholds and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import quantiles as q
from patronage.operators import reports as r
from patronage.operators.churn import fixed_risk_levels
from patronage.operators.normal_map import quantile_marks
from patronage.operators.selection import quantiles
from patronage.queries.base import (
    AS_OF, CHURN, REVENUE, RFM_CHURN, RUNS, TX, query, rounded, run_tables, scored, segmented,
    table, transactions,
)
from patronage.operators.rollups import customer_rollup
from patronage.session import materialize


@query(
    "q1_quintile_codes",
    f"WITH {RFM_CHURN} SELECT customer_id, r AS recency_score, frequency_score, monetary_score FROM coded",
)
def q1(spark, folder):
    df = materialize(customer_rollup(transactions(spark, folder), AS_OF), "q1")
    out = q.with_quintiles(
        df, {"days_since_last_purchase": "recency_score", "transaction_count": "frequency_score", "total_amount": "monetary_score"}
    )
    return out.select("customer_id", "recency_score", "frequency_score", "monetary_score")


@query(
    "q2_percentiles",
    "SELECT round(quantile_cont(o_totalprice, 0.33), 4) AS p33, round(quantile_cont(o_totalprice, 0.67), 4) AS p67 FROM orders",
)
def q2(spark, folder):
    values = quantiles(table(spark, folder, "orders"), {"o_totalprice": [0.33, 0.67]})["o_totalprice"]
    return rounded(spark.createDataFrame([tuple(values)], "p33 double, p67 double"), p33=4, p67=4)


@query(
    "q3_sorted_values",
    """WITH o AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS place, count(*) OVER () AS n FROM orders)
    SELECT max(CASE WHEN place = CAST(floor(n * 0.9e0) AS BIGINT) + 1 THEN x END) AS high,
    max(CASE WHEN place = CAST(floor(n * 0.7e0) AS BIGINT) + 1 THEN x END) AS medium FROM o""",
)
def q3(spark, folder):
    values = q.sorted_value_at(table(spark, folder, "orders"), "o_totalprice", [0.9, 0.7])
    return spark.createDataFrame([tuple(values)], "high double, medium double")


@query(
    "q4_above_upper_quartile",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.75) FROM orders)",
)
def q4(spark, folder):
    return q.above_quantile(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


def _marks_sql(c):
    return f"""SELECT '{c}' AS column_name, k AS place, round(a.v + (b.v - a.v) * ((a.n - 1) * k % 999) / 999e0, 6) AS mark
    FROM (SELECT unnest(generate_series(0, 999)) AS k), places a, places b
    WHERE a.c = '{c}' AND b.c = '{c}' AND a.r = (a.n - 1) * k // 999 AND b.r = least(a.r + 1, a.n - 1)"""


@query(
    "q5_marks",
    """WITH stacked AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME c VALUE v),
    places AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY c) AS n FROM stacked) """
    + " UNION ALL ".join(map(_marks_sql, ("l_quantity", "l_extendedprice", "l_discount"))),
)
def q5_marks(spark, folder):
    """The thousand marks per column on which the normal map rests."""
    marks = quantile_marks(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    rows = [(c, k, v) for c, values in marks.items() for k, v in enumerate(values)]
    return rounded(spark.createDataFrame(rows, "column_name string, place long, mark double"), mark=6)


@query("q5_normal_map")
def q5(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return q.apply_normal_map(df, quantile_marks(df, ["l_quantity", "l_extendedprice"]))


@query(
    "t1_history_newest_first",
    f"WITH {RUNS} SELECT user_id, analysis_id, timestamp, total_customers, high_risk_customers FROM history ORDER BY timestamp DESC, analysis_id DESC, user_id",
)
def t1(spark, folder):
    h = run_tables(spark, folder)["history"]
    rows = h.select("user_id", "analysis_id", "timestamp", "total_customers", "high_risk_customers")
    return rows.orderBy(F.desc("timestamp"), F.desc("analysis_id"), "user_id")


def _top_risk_sql(level):
    return f"""WITH {CHURN} SELECT customer_id, round(p, 6) AS churn_probability_final, round(total_amount, 2) AS total_amount,
    transaction_count FROM risk WHERE risk_level = '{level}' ORDER BY p DESC, customer_id LIMIT 10"""


def _display(df):
    return rounded(df, churn_probability_final=6, total_amount=2)


@query("t2_top_high_risk", _top_risk_sql("High Risk"))
def t2(spark, folder):
    return _display(r.top_risk(scored(spark, folder), "High Risk"))


@query("t2_top_medium_risk", _top_risk_sql("Medium Risk"))
def t2_medium(spark, folder):
    return _display(r.top_risk(scored(spark, folder), "Medium Risk"))


LISTED = "customer_id, round(total_amount, 2) AS total_amount, round(p, 6) AS churn_probability_final, risk_level"
Q75 = "(SELECT quantile_cont(total_amount, 0.75) FROM risk)"


@query("t3_retention_list", f"WITH {CHURN} SELECT {LISTED} FROM risk WHERE risk_level = 'High Risk' AND total_amount > {Q75} ORDER BY p DESC, customer_id LIMIT 3")
def t3(spark, folder):
    return _display(r.retention_list(scored(spark, folder)))


BALANCES = """scored AS (SELECT c_custkey AS customer_id, c_acctbal AS total_amount, (c_custkey * 37 % 1000) / 1000e0 AS p FROM customer),
levelled AS (SELECT *, CASE WHEN p >= 0.4e0 THEN 'High Risk' WHEN p >= 0.2e0 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level FROM scored)"""


@query(
    "t3_retention_by_balance",
    f"""WITH {BALANCES} SELECT customer_id, total_amount, round(p, 6) AS churn_probability_final, risk_level FROM levelled
    WHERE risk_level = 'High Risk' AND total_amount > (SELECT quantile_cont(total_amount, 0.75) FROM levelled) ORDER BY p DESC, customer_id LIMIT 3""",
)
def t3_balance(spark, folder):
    """Customers ranked by a spread score, so that rich ones are among the endangered."""
    df = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("total_amount"),
        ((F.col("c_custkey") * 37 % 1000) / 1000).alias(r.P),
    )
    return rounded(r.retention_list(fixed_risk_levels(df, r.P)), churn_probability_final=6)


@query("t4_upsell_list", f"WITH {CHURN} SELECT {LISTED} FROM risk r WHERE risk_level = 'Low Risk' AND total_amount > {Q75} ORDER BY r.total_amount DESC, customer_id LIMIT 3")
def t4(spark, folder):
    return _display(r.upsell_list(scored(spark, folder)))


@query("t5_rising_risk", f"WITH {CHURN} SELECT {LISTED} FROM risk WHERE risk_level <> 'High Risk' ORDER BY p DESC, customer_id LIMIT 3")
def t5(spark, folder):
    return _display(r.rising_risk(scored(spark, folder)))


@query(
    "t6_high_value_list",
    f"""WITH {REVENUE} SELECT customer_id, target_revenue AS predicted_revenue, monetary AS total_revenue,
    frequency AS transaction_count FROM segmented
    WHERE target_revenue > (SELECT quantile_cont(target_revenue, 0.75) FROM segmented)
    ORDER BY target_revenue DESC, customer_id LIMIT 10""",
)
def t6(spark, folder):
    df = segmented(spark, folder).select(
        "customer_id", F.col("target_revenue").alias("predicted_revenue"), F.col("monetary").alias("total_revenue"),
        F.col("frequency").alias("transaction_count"),
    )
    return r.high_value_list(df)


@query(
    "t7_latest_run",
    f"""WITH {RUNS}, newest AS (SELECT user_id, max(analysis_id) AS analysis_id FROM churn GROUP BY user_id)
    SELECT c.* FROM churn c SEMI JOIN newest USING (user_id, analysis_id)""",
)
def t7(spark, folder):
    return r.latest_run(run_tables(spark, folder)["churn"])


@query("t8_preview", f"WITH {TX} SELECT * FROM tx ORDER BY date, transaction_id LIMIT 10")
def t8(spark, folder):
    return r.preview(transactions(spark, folder), ["date", "transaction_id"])
