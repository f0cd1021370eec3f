"""Model steps. Each search runs once per session and table, over the whole declared grid; the queries share its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import models as m
from patronage.operators.features import CHURN_FEATURES, REVENUE_FEATURES, feature_matrix, rfm_features, value_features
from patronage.operators import churn, revenue
from patronage.operators.cut_trees import cut_back
from patronage.operators.grown_forest import GrownForest
from patronage.operators.rollups import customer_rollup
from patronage.operators.selection import with_row_index
from patronage.plans import analysis
from patronage.queries.base import AS_OF, CHURN, customers, query, rounded, scored, table, transactions
from patronage.session import materialize, scratch_path

_searched: dict[tuple, object] = {}


def once(spark, folder, name, make):
    """The result of a training run, made once per session, table folder and name."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _searched:
        _searched[key] = make()
    return _searched[key]


def churn_table(spark, folder):
    df = analysis.churn_features(customer_rollup(transactions(spark, folder), AS_OF), AS_OF)
    table_, names = feature_matrix(churn.label_churn(df), CHURN_FEATURES)
    return materialize(table_, "churn-table"), names


def revenue_table(spark, folder):
    df = rfm_features(customer_rollup(transactions(spark, folder), AS_OF), AS_OF, "revenue")
    df = revenue.drop_null_targets(revenue.revenue_target(value_features(df)))
    table_, names = feature_matrix(df, REVENUE_FEATURES)
    return materialize(table_, "revenue-table"), names


def churn_model(spark, folder):
    """The churn table and the model of the whole search."""
    def make():
        df, names = churn_table(spark, folder)
        return df, m.train_churn(df, names)

    return once(spark, folder, "churn", make)


def revenue_model(spark, folder):
    def make():
        df, names = revenue_table(spark, folder)
        return df, m.train_revenue(df, names)

    return once(spark, folder, "revenue", make)


def settings_of(spark, fitted):
    p = fitted.info["settings"]
    row = [(p["numTrees"], p["maxDepth"], p["minInstancesPerNode"], p[m.MIN_SPLIT])]
    return spark.createDataFrame(row, "trees int, depth int, min_leaf int, min_split int")


@query(
    "l1_stratified_split",
    f"""WITH {CHURN} SELECT first_label AS churn_label, count(*) - CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS train_rows,
    CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS test_rows FROM risk GROUP BY first_label""",
)
def l1(spark, folder):
    df = m.split_rows(churn.initial_label(scored(spark, folder)).select("customer_id", "churn_label"), label="churn_label")
    return df.groupBy("churn_label").agg(
        F.count_if("is_train").alias("train_rows"), F.count_if(~F.col("is_train")).alias("test_rows")
    )


@query("l2_feature_selection")
def l2(spark, folder):
    _, fitted = churn_model(spark, folder)
    return spark.createDataFrame([(i, fitted.names[i]) for i in fitted.kept], "place int, feature string")


@query("l3_churn_search")
def l3(spark, folder):
    return settings_of(spark, churn_model(spark, folder)[1])


@query("l4_revenue_search")
def l4(spark, folder):
    return settings_of(spark, revenue_model(spark, folder)[1])


@query(
    "l5_single_class",
    """WITH c AS (SELECT DISTINCT o_custkey AS customer_id FROM orders)
    SELECT customer_id, k AS churn_label, CAST(k AS DOUBLE) AS prediction, CAST(0 AS DOUBLE) AS churn_probability_final FROM c, (VALUES (0), (1)) v(k)""",
)
def l5(spark, folder):
    """All customers in one class, once the one and once the other."""
    df, names = churn_table(spark, folder)
    parts = []
    for k in (0, 1):
        one = df.withColumn("churn_label", F.lit(k))
        scored_ = m.score_churn(m.train_churn(one, names), one)
        parts.append(scored_.select("customer_id", "churn_label", "prediction", "churn_probability_final"))
    return parts[0].unionByName(parts[1])


@query(
    "l6_duplicate_lone_class",
    f"""WITH {CHURN}, best AS (SELECT customer_id FROM risk ORDER BY p DESC, customer_id LIMIT 1),
    t AS (SELECT r.customer_id, CASE WHEN b.customer_id IS NULL THEN 0 ELSE 1 END AS churn_label
      FROM risk r LEFT JOIN best b USING (customer_id))
    SELECT * FROM t UNION ALL SELECT * FROM t WHERE churn_label = 1""",
)
def l6(spark, folder):
    lone = churn.ensure_both_classes(scored(spark, folder).withColumn("churn_label", F.lit(0)))
    return m.duplicate_lone_class(lone.select("customer_id", "churn_label"))


@query("l7_tiny_revenue_forest")
def l7(spark, folder):
    # One row per order status: the tiny table this branch is for, drawn from all orders.
    per = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("customer_id")).agg(
        F.sum("o_totalprice").alias("monetary"), F.count(F.lit(1)).alias("frequency")
    )
    df, names = feature_matrix(per.withColumn("target_revenue", F.col("monetary")), ["monetary", "frequency"])
    df = materialize(df, "tiny")
    return m.score_revenue(m.train_revenue(df, names), df).select("customer_id", "predicted_revenue")


@query(
    "l8_score_churn",
    "SELECT o_custkey AS customer_id, true AS scored FROM orders GROUP BY o_custkey",
)
def l8(spark, folder):
    """Every customer is scored, within 0..1, and the class is the one that the probability says."""
    df, fitted = churn_model(spark, folder)
    p = F.col("churn_probability_final")
    agrees = (F.col("prediction") == (p > 0.5).cast("double")) | (p == 0.5)
    return m.score_churn(fitted, df).select("customer_id", (p.between(0, 1) & agrees).alias("scored"))


@query("l8_churn_scores")
def l8_scores(spark, folder):
    df, fitted = churn_model(spark, folder)
    return m.score_churn(fitted, df).select("customer_id", "churn_probability_final")


@query(
    "l9_class_metrics",
    """WITH t AS (SELECT quality AS y, toxic AS p FROM labels), k AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp,
      count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = p) AS ok,
      count(*) AS n FROM t)
    SELECT round(ok / n, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall FROM k""",
)
def l9(spark, folder):
    return rounded(m.class_metrics(table(spark, folder, "labels"), "quality", "toxic"), accuracy=9, precision=9, recall=9)


@query(
    "l10_roc_auc",
    """WITH t AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY s),
    r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 9) AS roc_auc FROM r""",
)
def l10(spark, folder):
    df = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(m.roc_auc(df, "quality", "n_chars"), roc_auc=9)


@query(
    "l11_regression_metrics",
    """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1),
    t AS (SELECT o_totalprice AS y, p FROM orders JOIN l ON l_orderkey = o_orderkey)
    SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2_score,
    round(avg((y - p) * (y - p)) / 1e6, 6) AS mse, round(avg(abs(y - p)), 6) AS mae FROM t""",
)
def l11(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("p"))
    df = table(spark, folder, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    out = m.regression_metrics(df, "o_totalprice", "p").withColumn("mse", F.col("mse") / 1e6)
    return rounded(out, r2_score=6, mse=6, mae=6)


@query("l12_saved_model", "SELECT o_custkey AS customer_id, true AS same_score, true AS same_class FROM orders GROUP BY o_custkey")
def l12_saved(spark, folder):
    """Scores by the model as trained beside those by the model as saved and loaded."""
    df, fitted = churn_model(spark, folder)
    path = scratch_path(spark, "saved-model")
    fitted.write().save(path)
    loaded = m.Fitted.read().load(path)
    p = "churn_probability_final"
    # The second scores follow in the same rows, so nothing is joined.
    both = m.score_churn(fitted, df.select("customer_id", "features", *fitted.names)).withColumnsRenamed({p: "p", "prediction": "g"})
    both = m.score_churn(loaded, both)
    return both.select("customer_id", (F.col("p") == F.col(p)).alias("same_score"), (F.col("g") == F.col("prediction")).alias("same_class"))


@query("l3_split_size", "SELECT 5 AS min_split, true AS no_small_splits, true AS same_roots")
def l3_split_size(spark, folder):
    """The searched churn forest cut back to five rows a split: no smaller node is split, and each tree begins as it did."""
    fitted = churn_model(spark, folder)[1]
    before, after = scratch_path(spark, "forest"), scratch_path(spark, "forest")
    fitted.model.write().save(before)
    cut_back(fitted.model, 5).write().save(after)
    old, new = (GrownForest.load(path).nodes() for path in (before, after))
    roots = old.where("id = 0").select("treeID", "rawCount").exceptAll(new.where("id = 0").select("treeID", "rawCount"))
    return new.agg(
        F.lit(5).alias("min_split"), (F.count_if((F.col("leftChild") >= 0) & (F.col("rawCount") < 5)) == 0).alias("no_small_splits"),
        F.lit(roots.isEmpty()).alias("same_roots"),
    )


@query("l12_model_run")
def l12(spark, folder):
    df, fitted = churn_model(spark, folder)
    return m.model_run(df, "EnhancedRandomForest", fitted.used, m.evaluate_churn(fitted))


def rank_auc(t):
    """One row ``auc`` from the middle ranks of the rows with ``y`` = 1 along ``p``; rows are numbered range by range."""
    ranked = with_row_index(t.select("y", "p"), [F.col("p")], "rank", 1)
    at = ranked.groupBy("p").agg(F.avg("rank").alias("middle"), F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return at.agg(F.expr("(sum(pos * middle) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * sum(neg))").alias("auc"))


@query("l12_metrics_agree", "SELECT true AS accuracy, true AS recall, true AS roc_auc")
def l12_agree(spark, folder):
    """The stated metrics against plain formulas over the stored test predictions."""
    _, fitted = churn_model(spark, folder)
    stated = m.evaluate_churn(fitted)
    t = materialize(m.score_churn(fitted, fitted.test).selectExpr("churn_label AS y", "prediction AS g", "churn_probability_final AS p"), "test-scores")
    auc = rank_auc(t)
    near = lambda c, k: F.abs(c - F.lit(float(stated[k]))) < 1e-9
    plain = t.agg(
        near(F.avg((F.col("y") == F.col("g")).cast("double")), "accuracy").alias("accuracy"),
        near(F.sum(F.col("y") * F.col("g")) / F.sum("y"), "recall").alias("recall"),
    )
    return plain.withColumn("roc_auc", F.lit(abs(auc.first()["auc"] - stated["roc_auc"]) < 1e-9))


def churn_run(spark, folder):
    def make():
        recent = transactions(spark, folder).withColumnRenamed("date", "transaction_date")
        return analysis.analyze_churn(customer_rollup(transactions(spark, folder), AS_OF), AS_OF, recent)[0]

    return once(spark, folder, "churn-run", make)


def revenue_run(spark, folder):
    """The whole analysis; its search is that of ``revenue_model``, over the same features, and is not run twice."""
    def make():
        fitted = revenue_model(spark, folder)[1]
        return analysis.analyze_revenue(customer_rollup(transactions(spark, folder), AS_OF), AS_OF, fitted=fitted)[0]

    return once(spark, folder, "revenue-run", make)


def revenue_tables_run(spark, folder):
    return once(
        spark, folder, "revenue-tables-run",
        lambda: analysis.analyze_revenue_tables(customers(spark, folder), transactions(spark, folder), AS_OF)[0],
    )


@query("l13_churn_analysis")
def l13(spark, folder):
    return churn_run(spark, folder).select("customer_id", "churn_label", "churn_probability_final", "risk_level")


@query(
    "l13_churn_rows",
    "SELECT o_custkey AS customer_id, true AS in_range, true AS known_level, true AS known_label FROM orders GROUP BY o_custkey",
)
def l13_rows(spark, folder):
    return churn_run(spark, folder).select(
        "customer_id", F.col("churn_probability_final").between(0, 1).alias("in_range"),
        F.col("risk_level").isin(churn.LEVELS).alias("known_level"), F.col("churn_label").isin(0, 1).alias("known_label"),
    )


@query("l14_revenue_analysis")
def l14(spark, folder):
    return revenue_run(spark, folder).select(
        "customer_id", "predicted_revenue", "revenue_segment", "total_revenue", "transaction_count", "avg_transaction_value"
    )


HISTORY_ROWS = """SELECT o_custkey AS customer_id, round(fsum(o_totalprice), 4) AS total_revenue,
  count(o_totalprice) AS transaction_count, true AS predicted, true AS known_segment FROM orders GROUP BY o_custkey"""


@query("l14_revenue_rows", HISTORY_ROWS)
def l14_rows(spark, folder):
    out = revenue_run(spark, folder).select(
        "customer_id", "total_revenue", F.col("transaction_count").cast("long").alias("transaction_count"), (F.col("predicted_revenue") >= 0).alias("predicted"),
        F.col("revenue_segment").isin(revenue.HIGH, revenue.MEDIUM, revenue.LOW).alias("known_segment"),
    )
    return rounded(out, total_revenue=4)


@query("l15_revenue_from_tables")
def l15(spark, folder):
    return revenue_tables_run(spark, folder).select(
        "customer_id", "country", "predicted_revenue", "revenue_segment", "customer_lifetime_value"
    )


@query(
    "l15_rows_from_tables",
    """SELECT c_custkey AS customer_id, n_name AS country, true AS predicted FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def l15_rows(spark, folder):
    """Customers with a history; the others have no target and so no row."""
    return revenue_tables_run(spark, folder).where("transaction_count > 0").select(
        "customer_id", "country", (F.col("predicted_revenue") >= 0).alias("predicted")
    )
