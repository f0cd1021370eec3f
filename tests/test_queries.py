"""Every registered query against its SQL text, and a check of the plans that matter."""

import importlib
import re

import pytest

from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
base = importlib.import_module("patronage.queries.base")
QUERIES, SQL = base.QUERIES, base.SQL


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert all(re.fullmatch(r"[a-z]\d+_[a-z0-9_]+", n) for n in QUERIES)
    ids = {n.split("_")[0] for n in QUERIES}
    sizes = {"s": 13, "m": 18, "c": 16, "j": 11, "a": 20, "q": 5, "t": 8, "f": 13, "r": 12, "l": 15, "x": 10, "w": 3}
    assert ids == {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert compare(con, SQL[name], df) is None
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 150 and {"risk_level", "churn_probability", "churn_label"} <= set(df.columns)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["s6_transactions_since"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate" in text
    text = plan(QUERIES["a1_customer_rollup"](spark, FOLDER))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
    assert text.count("Exchange hashpartitioning") <= 2  # listed once in the tree, once in the details


def test_country_report_shrinks_before_it_joins(spark):
    text = plan(QUERIES["a12_country_top10"](spark, FOLDER))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["r1_risk_levels", "j8_dashboard_join", "x8_latest_dashboard", "a13_kpis", "w1_sessions"])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
