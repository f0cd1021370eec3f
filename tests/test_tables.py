"""Mapping, cleaning, screening and reports on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronage.operators import cleaning as c
from patronage.operators import mapping as m
from patronage.operators import reports as r
from patronage.operators import screening
from patronage.operators.rollups import customer_rollup
from patronage.plans import dashboard as board
from tests.conftest import values


def types(df, order_by=None):
    return {n: m.semantic_type(n, s) for n, s in m.sample_stats(df, order_by).items()}


def test_semantic_types(frame):
    rows = [
        (i, f"2024-01-{i % 28 + 1:02d}", f"{i}.5", f"name {i}", "DE", "toys", 20 + i, "F", i % 2, f"k{i}", -float(i)) for i in range(40)
    ]
    schema = ("customer_id long, created string, price string, full_label string, city string, product string, age long, "
              "sex string, flag string, code string, delta double")
    assert types(frame(rows, schema), "customer_id") == {
        "customer_id": "customer_id", "created": "date", "price": "amount", "full_label": "customer_name", "city": "location",
        "product": "category", "age": "age", "sex": "gender", "flag": "category", "code": "customer_id", "delta": "numeric",
    }


def test_sample_takes_first_filled_values_of_each_column(frame):
    rows = [(i, None if i < 300 else i % 10) for i in range(400)]
    stats = m.sample_stats(frame(rows, "k long, sparse long"), "k")
    assert stats["sparse"].rows == 100 and stats["sparse"].distinct == 10
    assert stats["k"].rows == 100 and stats["k"].high == 99.0


def test_uniqueness_close_to_the_cut_is_exact(frame):
    # 800 and 801 distinct values of 1000: only the second exceeds four fifths.
    rows = [(f"v{min(i, 799)}", f"v{min(i, 800)}") for i in range(1000)]
    stats = m.column_stats(frame(rows, "a string, b string"))
    assert (stats["a"].distinct, stats["b"].distinct) == (800, 801)


def test_auto_map_uses_fallbacks(frame):
    df = frame([(i, f"2024-02-{i % 28 + 1:02d}", -1.0 if i == 0 else 2.0, 3.0) for i in range(30)], "kk long, dd string, aa double, bb double")
    chosen = m.auto_map(df, "kk")
    # No name says anything: the id is the first nearly unique text, the date the first
    # column that parses (numbers do), the amount the first recognised by its values.
    assert (chosen["customer_id"], chosen["date"], chosen["amount"]) == ("dd", "kk", "bb")
    assert chosen["age"] is None


def test_dates(frame):
    rows = [(1, "2024-03-05"), (2, "03/05/2024"), (3, "20240305"), (4, "5 Mar 2024"), (5, "2024-03-05 10:11:12"), (6, "soon"), (7, None), (8, "13/45/2024")]
    got = dict(values(c.with_dates(frame(rows, "k long, d string"), "d"), "k", "d"))
    day = dt.datetime(2024, 3, 5)
    assert got == {1: day, 2: day, 3: day, 4: day, 5: day.replace(hour=10, minute=11, second=12), 6: None, 7: None, 8: None}


def test_numbers_and_days(frame):
    df = frame([(1, "12x", "3"), (2, " 7.5 ", "x"), (3, None, "4.9")], "k long, amount string, days_since_last_purchase string")
    assert values(c.with_numbers(df, {"amount": None}), "k", "amount") == [(1, None), (2, 7.5), (3, None)]
    assert values(c.days_as_integer(df, "2024-01-01"), "k", "days_since_last_purchase") == [(1, 3), (2, 0), (3, 4)]


def test_numeric_date_named_columns_stay(frame):
    df = frame([(5, "2024-01-02", "x")], "total_orders long, last_seen string, note string")
    out = m.parse_date_columns(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "timestamp_ntz", "string"]


def test_clean_and_join(frame):
    people = frame([(1, "f", 30, " de ", "2020-01-01"), (2, "m", 40, "fr\t", "bad"), (None, "f", 1, "x", None)],
                   "customer_id long, gender string, age long, country string, signup_date string")
    tx = frame([("a", 1, 5.0, "2024-01-01", "k"), ("b", 2, -1.0, "2024-01-01", "k"), ("c", 2, 0.0, "x", "k"), ("d", 2, 3.0, "x", "k"),
                ("e", None, 3.0, "x", "k"), ("f", 1, None, "x", "k"), ("g", 8, 3.0, "x", "k")],
               "transaction_id string, customer_id long, amount double, date string, category string")
    got = values(c.clean_and_join(people, tx), "transaction_id", "country", "date")
    assert got == [("a", "DE", dt.datetime(2024, 1, 1)), ("d", "FR", None)]
    with pytest.raises(c.EmptyInput):
        c.clean_and_join(people, tx.limit(0))
    with pytest.raises(c.EmptyInput):
        c.clean_and_join(people.where("customer_id = 1"), tx.where("customer_id = 8"))


def test_filters(frame):
    df = frame([(1, "A", "2024-01-01"), (2, "B", None), (3, "A", "2024-02-01")], "k long, country string, d string")
    df = df.withColumn("d", F.col("d").cast("timestamp_ntz"))
    assert c.select_values(df, {"country": []}).count() == 3
    assert c.select_values(df, {"country": ["A"]}).count() == 2
    assert values(c.between_dates(df, "d", "2024-01-01", "2024-01-31"), "k") == [(1,)]
    assert values(c.between_dates(df, "d", "2024-01-01", "2024-01-31", keep_null_dates=True), "k") == [(1,), (2,)]
    assert c.date_bounds(df, "d", dt.date(2024, 5, 1)) == (dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    assert c.date_bounds(df.limit(0), "d", dt.date(2024, 5, 1)) == (dt.date(2023, 5, 2), dt.date(2024, 5, 1))
    assert values(c.filter_options(df, "country"), "country") == [("A",), ("B",)]


def test_positional_rules(frame):
    tx = frame([(5, "2024-01-02"), (7, "2024-01-01"), (5, "2024-01-03")], "customer_id long, date string")
    people = frame([("a",), ("b",), ("c",)], "name string")
    got = values(m.ids_by_position(people, [F.col("name")], tx, "date"), "name", "customer_id")
    assert got == [("a", 7), ("b", 5), ("c", None)]
    dated = m.dates_by_position(people, [F.col("name")])
    assert values(dated, "name", "date") == [(n, dt.datetime(2020, 1, 1 + i)) for i, n in enumerate("abc")]
    assert values(m.number_customers(people, [F.col("name")]), "name", "customer_id") == [("a", 1), ("b", 2), ("c", 3)]


def test_small_mapping_rules(spark, frame):
    df = frame([("€5", 1.0)], "amount string, n double")
    assert m.currency_sign(df, "n") == "€"
    assert m.currency_sign(frame([("5",)], "amount string")) == "$"
    assert m.currency_sign(frame([("5",)], "`price £` string")) == "£"
    assert m.amount_from_first_number(frame([("x", 2, 3.0)], "t string, a int, b double")).first()["amount"] == 2
    assert m.report_columns(frame([(1, None)], "k long, country string")).first().asDict() == {
        "k": 1, "country": "Unknown", "gender": "Unknown", "risk_level": "Unknown", "revenue_segment": "Unknown", "total_revenue": 0}
    assert m.stamp_run(frame([(3,)], "analysis_id long"), "u").first().asDict() == {"analysis_id": 3, "user_id": "u"}
    full = frame([("DE", "f", "2024", 1.0)], "country string, gender string, last_purchase_date string, total_revenue double")
    assert m.is_complete(full)
    assert not m.is_complete(full.withColumn("gender", F.lit(None).cast("string")))
    assert not m.is_complete(full.drop("country"))
    c_, t_, merged = m.split_wide(frame([(1, 5.0, "2024", "A"), (1, 6.0, "2023", "B")], "customer_id long, amount double, date string, customer_name string"), ["date"])
    assert values(c_, "customer_id", "customer_name") == [(1, "B")]
    assert values(merged, "amount", "customer_name") == [(5.0, "B"), (6.0, "B")]


def test_screening(frame):
    texts = ["zed@shop.eu", "x' OR 1=1 --", "SELECT 1", "  zed@shop.eu ", "no mail", "0xFF@q.eu", "q" * 60 + "@q.eu", None, "zp_sp_z@q.eu"]
    out = screening.screen_text(frame(list(enumerate(texts)), "k long, t string"), "t")
    got = dict(values(out, "k", "safe_text"))
    assert got == {0: "zed@shop.eu", 1: "", 2: "", 3: "zed@shop.eu", 4: "", 5: "", 6: "", 7: "", 8: ""}
    assert dict(values(out, "k", "has_pattern"))[8] is True


def test_monthly_totals_show_empty_months(frame):
    df = frame([("2024-01-05", 1.0), ("2024-01-31", 2.0), ("2024-04-01", 5.0), (None, 9.0)], "d string, v double")
    df = df.withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = values(r.monthly_totals(df, "d", "v", "total"), "month", "total")
    assert got == [("2024-01", 3.0), ("2024-02", 0.0), ("2024-03", 0.0), ("2024-04", 5.0)]


def test_reports(frame):
    rows = [(1, "High Risk", 10.0, 0.9), (2, "Low Risk", 99.0, 0.1), (3, "Low Risk", 98.0, 0.2), (4, "Medium Risk", 1.0, 0.5), (5, "High Risk", 100.0, 0.8)]
    df = frame(rows, "customer_id long, risk_level string, total_amount double, churn_probability_final double").withColumn("transaction_count", F.lit(1))
    assert values(r.risk_level_counts(df.where("risk_level <> 'Medium Risk'")), "place", "risk_level", "customers") == [
        (0, "High Risk", 2), (1, "Medium Risk", 0), (2, "Low Risk", 2)]
    assert values(r.top_risk(df, "High Risk"), "customer_id") == [(1,), (5,)]
    assert values(r.retention_list(df), "customer_id") == [(5,)]
    assert r.upsell_list(df).count() == 0  # 99 is the upper quartile itself
    assert [x["customer_id"] for x in r.rising_risk(df).collect()] == [4, 3, 2]
    empty = r.kpis(df.limit(0).withColumn("total_revenue", F.lit(1.0))).first().asDict()
    assert empty == {"total_revenue": 0.0, "total_customers": 0, "high_risk_customers": 0, "churn_rate": 0.0}
    s = r.numeric_summary(df, ["total_amount"]).first()
    assert (s["n"], s["min"], s["q50"], s["max"]) == (5, 1.0, 98.0, 100.0)


def test_latest_run_and_dashboard(frame):
    view = frame([("a", 1, 1), ("a", 2, 2), ("b", 5, 3), ("c", None, 4)], "user_id string, analysis_id long, customer_id long")
    assert values(r.latest_run(view), "user_id", "customer_id") == [("a", 2), ("b", 3)]
    users = frame([("a",), ("c",)], "email string")
    assert values(board.latest_rows(view, users, "a"), "customer_id") == [(2,)]
    assert board.latest_rows(view, users, "b").count() == 0
    assert board.latest_rows(view, users, "c").count() == 0
    rows = frame([(1, "DE", None, None, 5.0, "High Risk", "2024-01-02")],
                 "customer_id long, country string, gender string, revenue_segment string, total_revenue double, risk_level string, last_purchase_date string")
    ready = board.filtered(board.prepare(rows), country=["DE"], gender=["Unknown"])
    charts = board.charts(ready)
    assert charts["kpis"].first()["churn_rate"] == 100.0
    assert charts["revenue_by_month"].first()["month"] == "2024-01"


def test_small_amounts_are_added(frame):
    rows = [(1, 1e-7), (1, 2e-7), (2, 1e12), (2, 0.1), (2, 0.2), (3, None)]
    df = frame(rows, "customer_id long, amount double")
    got = {r.customer_id: r.total_amount for r in customer_rollup(df).collect()}
    assert got[1] == pytest.approx(3e-7, rel=1e-12) and got[2] == 1e12 + 0.3 and got[3] == 0.0


def test_nested_columns_are_reported(frame):
    df = frame([(1, [1.0, 2.0], {"a": 1}), (2, None, None)], "customer_id long, vector array<double>, props map<string,int>")
    stats = m.column_stats(df)
    assert list(stats) == df.columns and [m.semantic_type(n, s) for n, s in stats.items()][1:] == ["unknown", "unknown"]
    assert stats["vector"].rows == 1 and not {"vector", "props"} & set(m.auto_map(df, "customer_id").values())
