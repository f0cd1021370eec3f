"""Runs in the catalog: joins without a shuffle, a permanent view, deletion and compaction."""

import uuid

import pytest
from pyspark.sql import functions as F

from patronage.operators.joins import dashboard_join
from patronage.sources.catalog import RunCatalog
from tests.conftest import values


def run_tables(spark, run, tenants=("a@x", "b@x"), n=400):
    key = spark.range(n).select(
        F.element_at(F.array(*map(F.lit, tenants)), (F.col("id") % len(tenants) + 1).cast("int")).alias("user_id"), F.lit(run).cast("long").alias("analysis_id"),
        F.col("id").cast("string").alias("customer_id"), "id",
    )
    none = F.lit(None)
    return {
        "customer_data": key.select(
            "user_id", "analysis_id", "customer_id", F.concat(F.lit("n"), "id").alias("customer_name"), none.cast("int").alias("age"), none.cast("string").alias("gender"),
            F.lit("DE").alias("country"), F.col("id").cast("double").alias("total_spent"), F.col("id").alias("transaction_count"),
            F.lit("2024-01-01").cast("date").alias("first_purchase_date"), F.lit("2024-01-02").cast("date").alias("last_purchase_date"),
        ),
        "churn_data": key.where("id % 7 > 0").select(
            "user_id", "analysis_id", "customer_id", (F.col("id") / n).alias("churn_probability"), F.lit("Low Risk").alias("risk_level"),
            F.lit(1).alias("days_since_last_purchase"),
        ),
        "revenue_data": key.select(
            "user_id", "analysis_id", "customer_id", F.col("id").cast("double").alias("total_revenue"), (F.col("id") * 2.0).alias("predicted_revenue"),
            F.lit("Low Value").alias("revenue_segment"), F.lit(1.0).alias("avg_transaction_value"),
        ),
        "analysis_history": key.select("user_id", "analysis_id", F.lit("2024-01-03").cast("timestamp_ntz").alias("timestamp")).distinct(),
    }


@pytest.fixture
def catalog(spark, tmp_path):
    made = RunCatalog(spark, f"runs_{uuid.uuid4().hex[:8]}", f"{tmp_path}/db", buckets=4)
    yield made
    spark.sql(f"DROP DATABASE {made.database} CASCADE")


def test_children_join_without_an_exchange(spark, catalog):
    tables = run_tables(spark, 1)
    catalog.append(tables)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # the history only
    try:
        catalog.create_view()
        for df in (catalog.dashboard(), catalog.table("full_dashboard_data")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 3
            assert "Exchange hashpartitioning" not in plan
        shuffled = dashboard_join(*(tables[t] for t in ("customer_data", "analysis_history", "churn_data", "revenue_data")))
        assert "Exchange hashpartitioning" in shuffled._jdf.queryExecution().executedPlan().toString()
        got = values(catalog.dashboard(), *shuffled.columns)
        assert len(got) == 400 and got == values(shuffled, *shuffled.columns) == values(catalog.table("full_dashboard_data"), *shuffled.columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_runs_come_and_go(spark, catalog):
    assert not catalog.exists("churn_data")
    for run in (1, 2):
        catalog.append(run_tables(spark, run, n=50))
    half = run_tables(spark, 3, n=50)
    del half["analysis_history"]
    catalog.append(half)  # a run whose writer died
    assert catalog.exists("churn_data") and catalog.table("customer_data").count() == 150 and catalog.dashboard().count() == 100
    catalog.delete_runs(spark.createDataFrame([("a@x", 1)], "user_id string, analysis_id long"))
    assert {(r.user_id, r.analysis_id): r["count"] for r in catalog.dashboard().groupBy("user_id", "analysis_id").count().collect()} == {
        ("b@x", 1): 25, ("a@x", 2): 25, ("b@x", 2): 25}
    assert catalog.table("revenue_data").count() == 150
    catalog.compact()
    assert catalog.table("revenue_data").count() == 75 and catalog.dashboard().count() == 75
    catalog.append(run_tables(spark, 4, n=10))
    assert catalog.dashboard().count() == 85


def test_what_is_there(spark, catalog):
    catalog.append(run_tables(spark, 1, n=20))
    catalog.create_view()
    assert catalog.exists("full_dashboard_data") and not catalog.exists("nothing")
    listed = values(catalog.columns("full_dashboard_data"), "place", "column_name", "data_type")
    assert len(listed) == 18 and (0, "analysis_id", "bigint") in listed
    assert [r.customer_id for r in catalog.first_rows("full_dashboard_data", [F.col("customer_id").cast("int")], 3).collect()] == ["0", "1", "2"]
