import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patronage.operators import cells
from patronage.operators import runs as x
from patronage.plans import dashboard as board
from patronage.plans.run import run_analysis
from patronage.sources import files
from patronage.sources.store import RunStore
from tests.conftest import values

AT = dt.datetime(2024, 1, 10, 12)


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def results(frame, n=4):
    churn = frame([(i, 0.2 * i, "Low Risk", 10.0 * i, i, i, dt.datetime(2024, 1, i + 1)) for i in range(n)],
                  "customer_id long, churn_probability_final double, risk_level string, total_amount double, transaction_count long, "
                  "days_since_last_purchase long, last_purchase timestamp_ntz")
    revenue = frame([(i, 5.0 * i, 4.0 * i, "Low Value", i, 1.0) for i in range(n)],
                    "customer_id long, predicted_revenue double, total_revenue double, revenue_segment string, transaction_count long, avg_transaction_value double")
    people = frame([(i, f"n{i}", "DE") for i in range(n)], "customer_id long, customer_name string, country string")
    return churn, revenue, people


def test_save_list_and_read_back(store, frame):
    run = store.save_run("a@x.eu", *results(frame), at=AT)
    h = store.history("a@x.eu").collect()
    assert [(r["analysis_id"], r["total_customers"], r["high_risk_customers"], r["total_predicted_revenue"]) for r in h] == [(run, 4, 1, 30.0)]
    assert h[0]["analysis_summary"] == "Analysis completed for 4 customers."
    d = store.details("a@x.eu", run)
    assert {n: t.count() for n, t in d.items()} == {"churn_data": 4, "revenue_data": 4, "customer_data": 4}
    assert all(t.count() == 0 for t in store.details("b@x.eu", run).values())
    rows = store.run_rows("churn_data", "a@x.eu", run)
    assert values(rows, "customer_id", "last_activity")[1] == ("1", dt.date(2024, 1, 2))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "analysis_id" in plan


def test_a_run_total_has_more_digits_than_the_amounts(store, frame):
    churn, revenue, people = results(frame)
    revenue = revenue.withColumn("predicted_revenue", F.lit(8e12))  # each fits an amount's fifteen digits, their sum does not
    store.save_run("a@x.eu", churn, revenue, people, at=AT)
    assert [r["total_predicted_revenue"] for r in store.history("a@x.eu").collect()] == [3.2e13]


def test_totals_written_with_fewer_digits_are_read(spark, store):
    old = "timestamp timestamp_ntz, total_customers int, total_predicted_revenue decimal(15,2), avg_predicted_revenue decimal(15,2)"
    spark.createDataFrame([(AT, 4, Decimal("30.25"), Decimal("7.56"))], old).write.parquet(store._folder("analysis_history", "a@x.eu", 7))
    assert [(r["analysis_id"], r["total_predicted_revenue"]) for r in store.history("a@x.eu").collect()] == [(7, 30.25)]


def test_dashboard_from_totals(store, frame):
    churn, revenue, people = results(frame, 30)
    churn = churn.withColumn("risk_level", F.when(F.col("customer_id") % 3 == 0, "High Risk").otherwise("Low Risk"))
    revenue = revenue.withColumn("revenue_segment", F.when(F.col("customer_id") % 4 > 0, F.concat(F.lit("S"), F.col("customer_id") % 4)))
    people = people.withColumns({
        "country": F.when(F.col("customer_id") % 5 > 0, F.concat(F.lit("C"), F.col("customer_id") % 5)), "gender": F.lit(None).cast("string"),
        "last_purchase_date": F.when(F.col("customer_id") > 2, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("customer_id") * 9).cast("int"))),
    })
    store.save_run("a@x.eu", churn, revenue, people, at=AT)
    store.save_run("b@x.eu", churn, revenue, people, at=AT)
    rows, totals = board.prepare(store.dashboard("a@x.eu")), board.prepare(store.latest_cells("a@x.eu"))
    assert 1 < totals.count() < 31 and totals.agg(F.sum("customers")).first()[0] == 30
    choices = [{}, {"country": ["C1", "C2", "Unknown"]}, {"segment": ["S1"], "start": dt.date(2024, 2, 1), "end": dt.date(2024, 8, 9)}, {"keep_null_dates": True}, {"country": ["none"]}]
    for chosen in choices:
        a, b = board.charts(board.filtered(rows, today=AT, **chosen)), cells.charts(board.filtered(totals, today=AT, **chosen))
        for name in a:
            assert [[float(v) if isinstance(v, (int, float)) else v for v in r] for r in a[name].collect()] == [
                [pytest.approx(float(v)) if isinstance(v, (int, float)) else v for v in r] for r in b[name].select(*a[name].columns).collect()], (name, chosen)
    assert store.latest_cells("c@x.eu").count() == 0


def test_unfinished_run_is_not_seen(store, frame):
    churn, revenue, _ = results(frame)
    store.append_results("a@x.eu", 7, churn, revenue, AT)
    assert store.table("churn_data").count() == 4
    assert store.rows("churn_data").count() == 0 and store.dashboard().count() == 0


def test_failed_append_leaves_nothing(store, frame):
    churn, revenue, _ = results(frame)
    broken = revenue.withColumn("predicted_revenue", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(Exception, match="boom"):
        store.append_results("a@x.eu", 7, churn, broken, AT)
    assert store.table("churn_data").count() == 0


def test_retention_and_deletion(store, frame):
    old = store.save_run("a@x.eu", *results(frame), at=AT - dt.timedelta(days=4))
    edge = store.save_run("a@x.eu", *results(frame), at=AT - dt.timedelta(days=3))
    new = store.save_run("a@x.eu", *results(frame), at=AT)
    other = store.save_run("b@x.eu", *results(frame), at=AT - dt.timedelta(days=9))
    assert store.cleanup("a@x.eu", AT) == [old]  # exactly three days is kept
    assert {r["analysis_id"] for r in store.history("a@x.eu").collect()} == {edge, new}
    assert store.rows("churn_data", "b@x.eu").count() == 4
    assert not store.delete_run("a@x.eu", other) and store.delete_run("a@x.eu", edge)
    assert store.table("churn_data").where(F.col("analysis_id") == edge).count() == 0


def test_users_quota_and_latest(spark, store, frame):
    users = "email string, subscription string, role string, created_at timestamp_ntz"
    store.upsert_users(frame([("a@x.eu", "Free", "user", AT), ("b@x.eu", "Premium", "user", AT)], users))
    store.upsert_users(frame([("a@x.eu", "Free", "developer", AT), ("a@x.eu", "Free", "user", AT + dt.timedelta(1)), ("c@x.eu", None, None, AT)], users))
    assert values(store.users(), "email", "role") == [("a@x.eu", "user"), ("b@x.eu", "user"), ("c@x.eu", None)]
    assert store.quota("a@x.eu", AT.date()) == {"runs": 0, "allowed": True, "remaining": 2}
    first = store.save_run("a@x.eu", *results(frame), at=AT)
    second = store.save_run("a@x.eu", *results(frame, 3), at=AT + dt.timedelta(seconds=1))
    assert store.quota("a@x.eu", AT.date()) == {"runs": 2, "allowed": False, "remaining": 0}
    assert store.quota("b@x.eu", AT.date())["remaining"] is None
    assert second > first
    assert {r["analysis_id"] for r in store.latest("a@x.eu").collect()} == {second}
    assert store.latest("nobody").count() == 0 and store.latest("b@x.eu").count() == 0
    store.create_view("dash")
    assert spark.sql("select count(*) from dash").first()[0] == 7
    store.delete_tenant("a@x.eu", AT)
    assert store.history("a@x.eu").count() == 0 and values(store.users(), "email") == [("b@x.eu",), ("c@x.eu",)]
    assert values(store.events(), "event_type", "email") == [("DELETE_ACCOUNT", "a@x.eu")]


def test_two_writers_of_users_lose_nothing(store, frame):
    users = "email string, subscription string, role string, created_at timestamp_ntz"
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(store.upsert_users, frame([(f"{k}@x.eu", "Free", "user", AT)], users, 1)) for k in range(4)]
        [j.result() for j in jobs]
    assert values(store.users(), "email") == [(f"{k}@x.eu",) for k in range(4)]
    claim = store.spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/users/claim-5")
    claim.getFileSystem(store.spark._jsc.hadoopConfiguration()).createNewFile(claim)
    with pytest.raises(TimeoutError):
        store._change_users(lambda u: u, wait=0.5)


def test_two_runs_written_at_once(store, frame):
    tables = [results(frame, 3), results(frame, 5)]
    with ThreadPoolExecutor(2) as pool:
        runs = [j.result() for j in [pool.submit(store.save_run, "a@x.eu", *t, AT) for t in tables]]
    assert [store.run_rows("churn_data", "a@x.eu", r).count() for r in runs] == [3, 5]


def test_upsert_picks_the_same_row(spark, frame):
    rows = [("k", v, AT) for v in range(20)]
    schema = "key string, v int, t timestamp_ntz"
    picks = {values(x.upsert(frame([], schema), frame(rows, schema, n), ["key"], order), "v")[0] for n in (1, 3, 7) for order in ("t",)}
    picks_without = {values(x.upsert(frame([], schema), frame(rows, schema, n), ["key"]), "v")[0] for n in (1, 3, 7)}
    assert len(picks) == 1 and len(picks_without) == 1


def test_daily_quota_report(frame):
    history = frame([("a", 1, AT), ("a", 2, AT), ("b", 3, AT), ("d", 4, AT)], "user_id string, analysis_id long, timestamp timestamp_ntz")
    users = frame([("a", "Free", "user"), ("b", "Premium", "user")], "email string, subscription string, role string")
    got = values(x.daily_quota(history, users), "user_id", "runs", "allowed", "remaining")
    assert got == [("a", 2, False, 0), ("b", 1, True, None), ("d", 1, False, 0)]


def test_typed_csv(spark, frame, tmp_path):
    tx = frame([("t1", 1, 2.5, "2024-01-01", "k")], files.TRANSACTION_SCHEMA, 1)
    files.write_csv(tx, str(tmp_path / "tx"))
    assert files.read_transactions_csv(spark, str(tmp_path / "tx")).collect() == tx.collect()
    (tmp_path / "bad.csv").write_text("transaction_id,customer_id,amount,date,category\nt1,12x,1.0,2024-01-01,k\n")
    with pytest.raises(Exception):
        files.read_transactions_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_whole_run(store, frame):
    people = frame([(i, f"n{i}", "DE", 20 + i % 50) for i in range(60)], "client_no long, nm string, land string, yrs long")
    tx = frame([(i % 60, f"2024-01-{i % 28 + 1:02d}", str(5.0 + i * 7 % 97)) for i in range(600)], "client_no long, happened string, paid string")
    quick = {"settings": None, "selector_trees": 5, "selector_depth": 3}
    roles = ({"customer_id": "client_no"}, {"customer_id": "client_no", "date": "happened", "amount": "paid"})
    assert not run_analysis(store, "a@x.eu", people, tx, *roles, at=dt.datetime(2024, 2, 1), training=quick).allowed  # no account
    store.upsert_users(frame([("a@x.eu", "Free", "user", AT)], "email string, subscription string, role string, created_at timestamp_ntz"))
    out = run_analysis(
        store, "a@x.eu", people, tx,
        {"customer_id": "client_no", "customer_name": "nm", "location": "land", "age": "yrs"},
        {"customer_id": "client_no", "date": "happened", "amount": "paid"}, at=dt.datetime(2024, 2, 1), training=quick,
    )
    assert out.allowed and out.customers == 60
    assert store.rows("revenue_data", "a@x.eu").count() == 60
    assert store.rows("customer_data", "a@x.eu").where("country = 'DE'").count() == 60
    assert store.rows("churn_data", "a@x.eu").where("churn_probability between 0 and 1").count() == 60
    assert store.load_model("a@x.eu", out.analysis_id, "churn").model.getNumTrees > 0
    for tenant, kind in (("b@x.eu", "churn"), ("a@x.eu", "revenue")):  # all customers buy equally often: no target, no revenue model
        with pytest.raises(LookupError):
            store.load_model(tenant, out.analysis_id, kind)
    kept = {"churn": store.load_model("a@x.eu", out.analysis_id, "churn")}
    again = run_analysis(store, "a@x.eu", people, tx, {"customer_id": "client_no", "age": "yrs"}, {"customer_id": "client_no", "date": "happened", "amount": "paid"},
                         at=dt.datetime(2024, 2, 1, 1), models=kept, training=quick)  # scored by the models of the first run
    scores = [values(store.run_rows("churn_data", "a@x.eu", r.analysis_id), "customer_id", "churn_probability") for r in (out, again)]
    assert scores[0] == scores[1] and again.churn_model.first()["accuracy"] == out.churn_model.first()["accuracy"]
    third = run_analysis(store, "a@x.eu", people, tx, {"customer_id": "client_no"}, {"customer_id": "client_no", "date": "happened", "amount": "paid"},
                         at=dt.datetime(2024, 2, 1, 2), training=quick)
    assert not third.allowed and third.analysis_id is None
    assert store.delete_run("a@x.eu", out.analysis_id)
    with pytest.raises(LookupError):
        store.load_model("a@x.eu", out.analysis_id, "churn")
