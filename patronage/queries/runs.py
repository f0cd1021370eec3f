"""Stored runs and tenants."""

from __future__ import annotations

import datetime as dt
import zlib

from pyspark.sql import functions as F

from patronage.operators import cells
from patronage.operators import runs as x
from patronage.operators.reports import latest_run
from patronage.plans import dashboard as board
from patronage.plans.run import run_analysis
from patronage.queries.base import DASHBOARD, RUNS, catalogued_runs, customers, dashboard, query, rounded, run_tables, table, transactions
from patronage.queries.models import churn_model, revenue_model
from patronage.session import materialize, materialize_once, path_exists, scratch_path, scratch_root
from patronage.sources.store import RunStore

HISTORY = "user_id, analysis_id, total_customers, high_risk_customers, total_predicted_revenue, avg_predicted_revenue, analysis_summary"


@query("x1_run_totals", f"WITH {RUNS} SELECT {HISTORY} FROM history")
def x1(spark, folder):
    t = run_tables(spark, folder)
    return rounded(x.run_totals(t["churn"], t["revenue"]), total_predicted_revenue=4, avg_predicted_revenue=4)


@query(
    "x2_history_listing",
    f"""WITH {RUNS} SELECT analysis_id, timestamp, total_customers, high_risk_customers, total_predicted_revenue,
    avg_predicted_revenue, analysis_summary FROM history WHERE user_id = 'AUTOMOBILE' ORDER BY timestamp DESC""",
)
def x2(spark, folder):
    return x.history_listing(run_tables(spark, folder)["history"], "AUTOMOBILE")


def stored_runs(spark, folder) -> RunStore:
    """All runs of all tenants in a store, written as the store lays them out."""
    def key(name):
        return f"{scratch_root(spark)}/runs-{zlib.crc32(folder.encode()):08x}/{name}"

    store = RunStore(spark, key("store"))
    if not path_exists(spark, key("done")):
        t = run_tables(spark, folder, segments=True)
        for name, rows in (("churn_data", t["churn"]), ("revenue_data", t["revenue"]), ("customer_data", t["customers"]), ("analysis_history", t["history"])):
            store.load(name, rows)
        spark.range(1).write.mode("overwrite").parquet(key("done"))
    return store


def copied_runs(spark, folder) -> RunStore:
    """A store of its own with the same rows, to be changed."""
    source, store = stored_runs(spark, folder), RunStore(spark, scratch_path(spark, "runs"))
    for name in ("churn_data", "revenue_data", "customer_data", "analysis_history"):
        store.load(name, source.table(name))
    return store


CHILD_ROWS = """SELECT 'churn_data' AS child, customer_id, CAST(transaction_count AS DOUBLE) AS value FROM churn WHERE {0}
  UNION ALL SELECT 'revenue_data', customer_id, CAST(total_revenue AS DECIMAL(15,2))::DOUBLE FROM revenue WHERE {0}
  UNION ALL SELECT 'customer_data', customer_id, CAST(total_spent AS DECIMAL(15,2))::DOUBLE FROM people WHERE {0}"""


def child_rows(children):
    value = {"churn_data": "transaction_count", "revenue_data": "total_revenue", "customer_data": "total_spent"}
    parts = [
        rows.select(F.lit(name).alias("child"), "customer_id", F.col(value[name]).cast("double").alias("value")) for name, rows in children.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "s7_store_scan",
    f"""WITH {RUNS} SELECT user_id, analysis_id, customer_id, risk_level, CAST(transaction_count AS INTEGER) AS transaction_count, last_activity
    FROM churn WHERE user_id = 'BUILDING'""",
)
def s7_store(spark, folder):
    """One tenant's rows through the store, which lists that tenant's folder only."""
    rows = stored_runs(spark, folder).table("churn_data", "BUILDING")
    return rows.select("user_id", "analysis_id", "customer_id", "risk_level", "transaction_count", "last_activity")


@query("x3_all_children", f"WITH {RUNS} " + CHILD_ROWS.format("user_id = 'HOUSEHOLD' AND analysis_id = 1997"))
def x3_all(spark, folder):
    """The three children of a stored run, read through the store."""
    return child_rows(stored_runs(spark, folder).details("HOUSEHOLD", 1997))


def every_child(store):
    return child_rows({n: store.rows(n) for n in ("churn_data", "revenue_data", "customer_data")})


@query("x5_delete_run", f"WITH {RUNS} " + CHILD_ROWS.format("NOT (user_id = 'HOUSEHOLD' AND analysis_id = 1997)"))
def x5_run(spark, folder):
    """One stored run is deleted through the store, history and all children; the rest is read back."""
    store = copied_runs(spark, folder)
    store.delete_run("HOUSEHOLD", 1997)
    return every_child(store)


@query("x5_delete_account", f"WITH {RUNS} " + CHILD_ROWS.format("user_id <> 'BUILDING'"))
def x5_account(spark, folder):
    """A tenant is deleted through the store, with its account and a log entry."""
    store = copied_runs(spark, folder)
    store.delete_tenant("BUILDING", dt.datetime(2024, 1, 1))
    return every_child(store)


@query(
    "x4_cleanup",
    f"WITH {RUNS}, kept AS (SELECT user_id, analysis_id FROM history WHERE user_id <> 'MACHINERY' OR timestamp >= TIMESTAMP '2000-01-02' - INTERVAL 3 DAY) "
    + CHILD_ROWS.format("(user_id, analysis_id) IN (SELECT (user_id, analysis_id) FROM kept)"),
)
def x4_cleanup(spark, folder):
    """The retention of one tenant through the store: its old runs go, with all children."""
    store = copied_runs(spark, folder)
    store.cleanup("MACHINERY", "2000-01-02")
    return every_child(store)


@query(
    "x3_run_details",
    f"""WITH {RUNS} SELECT customer_id, predicted_revenue, total_revenue, revenue_segment, transaction_count, avg_transaction_value
    FROM revenue WHERE user_id = 'HOUSEHOLD' AND analysis_id = 1997""",
)
def x3(spark, folder):
    from patronage.operators.joins import owned_children

    t = run_tables(spark, folder, segments=True)
    return owned_children(t["revenue"], t["history"], "HOUSEHOLD", 1997).drop("user_id", "analysis_id")


@query(
    "x4_retention",
    f"""WITH {RUNS} SELECT c.* FROM churn c SEMI JOIN (SELECT * FROM history
    WHERE timestamp >= TIMESTAMP '2000-01-02' - INTERVAL 3 DAY) h USING (user_id, analysis_id)""",
)
def x4(spark, folder):
    t = run_tables(spark, folder)
    return x.retain(t["history"], [t["churn"]], "2000-01-02")[1]


@query("x5_delete_tenant", f"WITH {RUNS} SELECT * FROM churn WHERE user_id <> 'BUILDING'")
def x5(spark, folder):
    """Every tenant's rows are stored, one tenant is deleted, the rest is read back."""
    churn = run_tables(spark, folder)["churn"]
    path = scratch_path(spark, "tenants")
    rows = churn.hint("rebalance", "user_id", "analysis_id")
    rows.write.partitionBy("user_id", "analysis_id").parquet(f"{path}/churn_data")
    RunStore(spark, path)._drop_run("churn_data", "BUILDING")
    return spark.read.schema(churn.schema).parquet(f"{path}/churn_data")


PLANS = """users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS email, CASE WHEN user_id % 3 = 0 THEN 'Premium' ELSE 'Free' END
  AS subscription, CASE WHEN user_id % 10 = 0 THEN 'developer' ELSE 'user' END AS role FROM events WHERE event_type = 'signup'),
runs AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id AS analysis_id, ts AS timestamp FROM events)"""


def plans(spark, folder):
    """Every event is a run of its user; users who never signed up have no plan row."""
    e = table(spark, folder, "events")
    users = e.where("event_type = 'signup'").select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("email"),
        F.when(F.col("user_id") % 3 == 0, "Premium").otherwise("Free").alias("subscription"),
        F.when(F.col("user_id") % 10 == 0, "developer").otherwise("user").alias("role"),
    )
    runs = e.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").alias("analysis_id"), F.col("ts").alias("timestamp"))
    return runs, users


PLAN = "coalesce(subscription, 'Free') AS subscription, coalesce(role, 'user') AS role"


@query(
    "x6_daily_quota",
    f"""WITH {PLANS}, used AS (SELECT user_id, CAST(timestamp AS DATE) AS day, count(*) AS runs FROM runs GROUP BY 1, 2),
    p AS (SELECT used.*, {PLAN}, email IS NOT NULL AS known FROM used LEFT JOIN users ON email = used.user_id)
    SELECT user_id, day, runs, subscription, role, known AND (role = 'developer' OR subscription = 'Premium' OR runs < 2) AS allowed,
    CASE WHEN NOT known THEN 0 WHEN role <> 'developer' AND subscription <> 'Premium' THEN greatest(2 - runs, 0) END AS remaining FROM p""",
)
def x6(spark, folder):
    return x.daily_quota(*plans(spark, folder))


@query("x7_plan_lookup", f"WITH {PLANS}, k AS (SELECT DISTINCT user_id FROM runs) SELECT user_id, {PLAN} FROM k LEFT JOIN users ON email = user_id")
def x7(spark, folder):
    runs, users = plans(spark, folder)
    return x.plan_lookup(runs.select("user_id").distinct(), users)


@query(
    "x8_latest_dashboard",
    f"""WITH {DASHBOARD} SELECT * FROM dashboard WHERE user_id = 'FURNITURE'
    AND analysis_id = (SELECT max(analysis_id) FROM dashboard WHERE user_id = 'FURNITURE')""",
)
def x8(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("email")).distinct()
    rows = board.latest_rows(dashboard(spark, folder), users, "FURNITURE")
    return rows.select(*dashboard_columns())


TILES = f"""{DASHBOARD}, mine AS (SELECT * REPLACE (coalesce(country, 'Unknown') AS country, coalesce(revenue_segment, 'Unknown') AS revenue_segment)
  FROM dashboard WHERE user_id = 'HOUSEHOLD' AND analysis_id = (SELECT max(analysis_id) FROM dashboard WHERE user_id = 'HOUSEHOLD')
  AND last_purchase_date IS NOT NULL),
months AS (SELECT date_trunc('month', last_purchase_date) AS month, sum(total_revenue) AS v FROM mine GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(month) FROM months), (SELECT max(month) FROM months), INTERVAL 1 MONTH)) AS month),
tiles AS (SELECT 'kpis' AS chart, 'total_revenue' AS label, sum(total_revenue) AS value FROM mine
  UNION ALL SELECT 'kpis', 'total_customers', count(DISTINCT customer_id) FROM mine
  UNION ALL SELECT 'kpis', 'high_risk_customers', count(*) FILTER (risk_level = 'High Risk') FROM mine
  UNION ALL SELECT 'kpis', 'churn_rate', count(*) FILTER (risk_level = 'High Risk') / count(DISTINCT customer_id) * 100 FROM mine
  UNION ALL SELECT 'risk_levels', risk_level, count(*) FROM mine GROUP BY risk_level
  UNION ALL SELECT 'revenue_by_segment', revenue_segment, sum(total_revenue) FROM mine GROUP BY revenue_segment
  UNION ALL SELECT 'revenue_by_month', strftime(spine.month, '%Y-%m'), coalesce(v, 0) FROM spine LEFT JOIN months USING (month)
  UNION ALL SELECT * FROM (SELECT 'top_countries', country, sum(total_revenue) AS v FROM mine GROUP BY country ORDER BY v DESC, country LIMIT 10))"""


def stacked(charts):
    """All tiles and charts as rows of one table."""
    names = {"risk_levels": "risk_level", "revenue_by_segment": "revenue_segment", "revenue_by_month": "month", "top_countries": "country"}
    kpis = charts["kpis"]
    parts = [kpis.select(F.lit("kpis").alias("chart"), F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in kpis.columns]
    for chart, label in names.items():
        value = next(c for c in charts[chart].columns if c != label)
        parts.append(charts[chart].select(F.lit(chart).alias("chart"), F.col(label).alias("label"), F.col(value).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, value=4)


@query("x8_dashboard_charts", f"WITH {TILES} SELECT chart, label, round(CAST(value AS DOUBLE), 4) AS value FROM tiles")
def x8_charts(spark, folder):
    """The whole dashboard of one tenant: latest run, null fills, date filter, tiles and charts."""
    users = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("email")).distinct()
    rows = materialize(board.prepare(board.latest_rows(dashboard(spark, folder), users, "HOUSEHOLD")), "dashboard")
    return stacked(board.charts(board.filtered(rows)))


@query("x8_charts_from_totals", f"WITH {TILES} SELECT chart, label, round(CAST(value AS DOUBLE), 4) AS value FROM tiles")
def x8_from_totals(spark, folder):
    """The same dashboard from the totals that were written with the runs; no customer is read."""
    mark = f"run-cells-{zlib.crc32(folder.encode()):08x}"
    totals = materialize_once(spark, mark, lambda: cells.run_cells(catalogued_runs(spark, folder).dashboard()))
    return stacked(cells.charts(board.filtered(board.prepare(latest_run(totals.where("user_id = 'HOUSEHOLD'"))))))


@query(
    "x1_whole_run",
    """SELECT CAST(o_custkey AS VARCHAR) AS customer_id, round(sum(o_totalprice), 2) AS total_spent, count(*) AS transaction_count,
    true AS churn_scored, true AS revenue_predicted FROM orders GROUP BY o_custkey""",
)
def x1_whole_run(spark, folder):
    """Mapping, completion, joins, both models, store and retention in one stored run, read back from the store.

    Both models are those of the whole grid searches over these customers, which the session runs once.
    """
    store = RunStore(spark, scratch_path(spark, "whole-run"))
    at = dt.datetime(2001, 8, 2)
    account = [("a@x.eu", "Premium", "user", at)]
    store.upsert_users(spark.createDataFrame(account, "email string, subscription string, role string, created_at timestamp_ntz"))
    people = customers(spark, folder).select(F.col("customer_id").alias("client"), F.col("customer_name").alias("who"), F.col("country").alias("land"))
    sales = transactions(spark, folder).select(F.col("customer_id").alias("client"), F.col("date").alias("day"), F.col("amount").alias("paid"))
    done = run_analysis(
        store, "a@x.eu", people, sales, {"customer_id": "client", "customer_name": "who", "location": "land"},
        {"customer_id": "client", "date": "day", "amount": "paid"}, at,
        models={"churn": churn_model(spark, folder)[1], "revenue": revenue_model(spark, folder)[1]},
    )
    children = store.details("a@x.eu", done.analysis_id)
    scored = children["churn_data"].select("customer_id", F.col("churn_probability").between(0, 1).alias("churn_scored"))
    predicted = children["revenue_data"].select("customer_id", (F.col("predicted_revenue") >= 0).alias("revenue_predicted"))
    rows = children["customer_data"].select(
        "customer_id", F.col("total_spent").cast("double").alias("total_spent"), F.col("transaction_count").cast("long").alias("transaction_count")
    )
    return rows.join(scored, "customer_id", "left").join(predicted, "customer_id", "left")


def dashboard_columns():
    return ["analysis_id", "user_id", "customer_id", "customer_name", "age", "gender", "country", "total_revenue",
            "predicted_revenue", "churn_probability", "risk_level", "revenue_segment", "transaction_count",
            "avg_transaction_value", "first_purchase_date", "last_purchase_date", "days_since_last_purchase", "created_at"]


@query(
    "x9_upsert",
    """WITH existing AS (SELECT user_id, min(ts) AS last_login, 'old' AS state FROM events WHERE event_type <> 'signup' GROUP BY 1),
    incoming AS (SELECT user_id, max(ts) AS last_login, 'new' AS state FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT * FROM incoming UNION ALL SELECT * FROM existing ANTI JOIN incoming USING (user_id)""",
)
def x9(spark, folder):
    e = table(spark, folder, "events")
    existing = e.where("event_type <> 'signup'").groupBy("user_id").agg(F.min("ts").alias("last_login"), F.lit("old").alias("state"))
    incoming = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("last_login"), F.lit("new").alias("state"))
    return x.upsert(existing, incoming, ["user_id"], "last_login")


@query("x10_audit_report", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def x10(spark, folder):
    log = RunStore(spark, scratch_path(spark, "audit"))
    log.append_events(
        table(spark, folder, "events").select(
            "event_type", F.col("user_id").cast("string").alias("email"), F.col("props").alias("details"), F.col("ts").alias("timestamp")
        )
    )
    return x.event_report(log.events())
