import pytest
from pyspark.sql import functions as F

from patronage.operators import joins as j
from patronage.operators import rollups as u
from tests.conftest import values

TX = [("t1", 1, 10.0), ("t2", 1, 5.0), ("t3", 2, 7.0), ("t4", 9, 1.0), ("t5", None, 2.0)]
PEOPLE = [(1, "A"), (2, "B"), (3, "C")]


@pytest.fixture
def tables(frame):
    return frame(TX, "transaction_id string, customer_id long, amount double"), frame(PEOPLE, "customer_id long, country string")


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_many_to_one_joins(spark, tables, limit):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        tx, people = tables
        assert values(j.join_one(tx, people, validate=True), "transaction_id", "country") == [("t1", "A"), ("t2", "A"), ("t3", "B")]
        left = values(j.join_one(tx, people, how="left"), "transaction_id", "country")
        assert left == [("t1", "A"), ("t2", "A"), ("t3", "B"), ("t4", None), ("t5", None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_key_rows_are_not_shuffled(spark, frame):
    rows = [(i, 1 if i % 3 else i) for i in range(3000)]
    tx = frame(rows, "transaction_id long, customer_id long")
    people = frame([(i, f"c{i}") for i in range(0, 3000, 2)] + [(1, "hot")], "customer_id long, name string")
    assert j.hot_keys(tx, "customer_id") == [1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = j.join_one(tx, people, how="left")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = values(out, "transaction_id", "name")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    names = dict([(i, f"c{i}") for i in range(0, 3000, 2)] + [(1, "hot")])
    assert got == sorted(((i, names.get(c)) for i, c in rows), key=repr)


def test_duplicate_right_key_is_an_error(frame, tables):
    with pytest.raises(j.DuplicateKeyError):
        j.join_one(tables[0], frame([(1, "A"), (1, "B")], "customer_id long, country string"), validate=True)


def test_pairs_fan_out(frame):
    df = frame([(1, 5), (1, 5), (1, 7), (2, 3)], "customer_id long, days_since_last_purchase long")
    metrics = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    got = values(j.attach_pairs(metrics, df, "days_since_last_purchase"), "customer_id", "n", "days_since_last_purchase")
    assert got == [(1, 3, 5), (1, 3, 7), (2, 1, 3)]


def test_metrics_of_customers_without_transactions_are_zero(tables):
    tx, people = tables
    metrics = tx.where("customer_id is not null").groupBy("customer_id").agg(F.sum("amount").alias("total"))
    assert values(j.attach_metrics(people, metrics), "customer_id", "total") == [(1, 15.0), (2, 7.0), (3, 0.0)]


def test_first_row_and_lookup(frame, tables):
    df = frame([(1, "x", 2), (1, "y", 1), (2, None, 1)], "customer_id long, gender string, seq int")
    assert values(j.first_row_per_key(df, "customer_id", ["gender"], ["seq"]), "customer_id", "gender") == [(1, "y"), (2, None)]
    assert values(j.lookup_count(tables[1], tables[0], "n"), "customer_id", "n") == [(1, 2), (2, 1), (3, 0)]


def test_ownership_and_cascade(frame):
    child = frame([("a", 1, "x"), ("b", 2, "y")], "user_id string, analysis_id long, customer_id string")
    history = frame([("a", 1), ("b", 2)], "user_id string, analysis_id long")
    assert j.owned_children(child, history, "a", 1).count() == 1
    assert j.owned_children(child, history, "a", 2).count() == 0
    left = j.without_runs(child, history.where("analysis_id = 1"), ["user_id", "analysis_id"])
    assert values(left, "customer_id") == [("y",)]


def test_prepare_features_branches(frame):
    done = frame([(1, 5.0, 2, 3), (2, 1.0, 1, 9)], "client_id long, total_amount double, purchases long, days_since_order long")
    assert values(u.prepare_features(done, "2024-01-31"), "customer_id", "total_amount", "transaction_count") == [(1, 5.0, 2), (2, 1.0, 1)]
    rows = [(1, 4.0, "2024-01-01", "f"), (1, None, "2024-01-30 00:00:01", "m"), (2, 1.0, "bad", None), (None, 9.0, "2024-01-01", "f")]
    tx = frame(rows, "customer_id long, price double, date string, sex string")
    got = values(u.prepare_features(tx, "2024-01-31", ["date"]), "customer_id", "total_amount", "transaction_count", "days_since_last_purchase", "gender")
    assert got == [(1, 4.0, 1, 0, "f"), (2, 1.0, 1, None, None)]
    days = frame([(1, 2.0, 5), (1, 3.0, 6)], "customer_id long, amount double, days_since_last_purchase long")
    assert values(u.prepare_features(days, "2024-01-31"), "total_amount", "days_since_last_purchase") == [(5.0, 5), (5.0, 6)]
    bare = frame([("x",)], "name string")
    assert values(u.prepare_features(bare, "2024-01-31"), "customer_id", "total_amount") == [(0, 0)]


def test_sum_of_nothing_is_zero(frame):
    tx = frame([(1, None), (1, None)], "customer_id long, amount double")
    assert values(u.customer_rollup(tx), "customer_id", "total_amount", "transaction_count") == [(1, 0.0, 0)]


def test_one_to_many_keeps_both_sides(spark, frame):
    one = frame([(i, f"c{i}") for i in range(50)], "customer_id long, country string")
    many = frame([(7, k) for k in range(2000)] + [(3, 1), (None, 2), (99, 3)], "customer_id long, transaction_id int", 6)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = values(one.join(many, "customer_id", "left"), "customer_id", "country", "transaction_id")
    try:
        for threshold in (limit, "-1"):  # a broadcast, and the way of a large right side
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert values(j.one_to_many(one, many), "customer_id", "country", "transaction_id") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
