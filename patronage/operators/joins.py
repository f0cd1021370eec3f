"""Joins between transactions, customers and per-customer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.session import broadcast_limit, plan_bytes

HOT_KEYS = 64


class DuplicateKeyError(ValueError):
    """The "one" side of a many-to-one join repeats a key."""


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise when a key occurs twice."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if twice.take(1):
        raise DuplicateKeyError(f"{key} is not unique on the right side")


def hot_keys(df: DataFrame, key: str, share: float = 0.01, k: int = HOT_KEYS) -> list:
    """Keys that may hold ``share`` of the rows or more: a bounded sketch, at most ``k``."""
    row = df.agg(F.count(key).alias("n"), F.call_function("approx_top_k", F.col(key), F.lit(k), F.lit(64 * k)).alias("top")).first()
    return [t["item"] for t in row["top"] if t["item"] is not None and t["count"] >= share * row["n"]]


def join_one(
    many: DataFrame, one: DataFrame, key: str = "customer_id", how: str = "inner", validate: bool = False
) -> DataFrame:
    """Many-to-one equi-join that survives a hot key.

    A right side under the session's broadcast threshold is left to Catalyst,
    which broadcasts it. A larger one is shuffled - except that the rows of hot
    keys never are: each hot key has one right row, so the right rows of at
    most ``HOT_KEYS`` keys are broadcast to wherever the hot rows already lie.
    ``many`` is read once more for the keys, and once more if some are hot, so
    it should be a table or a written stage. ``one`` must be unique in ``key``
    (checked when ``validate``).
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if validate:
        assert_unique(one, key)
    limit = broadcast_limit(many.sparkSession)
    if 0 <= plan_bytes(one) <= limit:
        return many.join(one, key, how)
    hot = hot_keys(many, key)
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    if one.where(is_hot).limit(HOT_KEYS + 1).count() > HOT_KEYS:
        raise DuplicateKeyError(f"{key} is not unique on the right side")
    calm = many.where(~is_hot).join(one.where(~is_hot), key, how)
    heated = many.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how)  # <= HOT_KEYS rows
    return calm.unionByName(heated)


def one_to_many(one: DataFrame, many: DataFrame, key: str = "customer_id") -> DataFrame:
    """Every row of ``one`` with its rows of ``many``, or with nulls: a left join whose right side may have hot keys.

    The long side leads, so a hot key's rows stay where they are or are split;
    what has no match is found against the distinct keys, combined before
    their shuffle.
    """
    matched = join_one(many.where(F.col(key).isNotNull()), one, key)
    columns = [key, *[c for c in one.columns if c != key], *[c for c in many.columns if c != key]]
    alone = one.join(many.select(key).distinct(), key, "left_anti")
    return matched.select(*columns).unionByName(alone, allowMissingColumns=True).select(*columns)


def attach_metrics(customers: DataFrame, metrics: DataFrame, key: str = "customer_id") -> DataFrame:
    """Customers with their metrics; numbers of customers without any become 0."""
    return customers.join(metrics, key, "left").na.fill(0)


def attach_pairs(metrics: DataFrame, source: DataFrame, column: str, key: str = "customer_id") -> DataFrame:
    """Metrics with each distinct ``column`` value of the customer (fans out)."""
    return metrics.join(source.select(key, column).distinct(), key, "left")


def first_row_per_key(df: DataFrame, key: str, columns: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each key in ``order_by`` order: a combining aggregate, no sort."""
    first = F.min_by(F.struct(*columns), F.struct(*order_by))
    return df.groupBy(key).agg(first.alias("_first")).select(key, *[F.col(f"_first.{c}") for c in columns])


def lookup_count(df: DataFrame, events: DataFrame, name: str, key: str = "customer_id") -> DataFrame:
    """Rows of ``events`` per key, 0 where there are none."""
    tally = events.groupBy(key).agg(F.count("*").alias(name))
    return df.join(tally, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


RUN_KEY = ["user_id", "analysis_id"]
ROW_KEY = [*RUN_KEY, "customer_id"]


def with_results(customers: DataFrame, churn: DataFrame, revenue: DataFrame) -> DataFrame:
    """Customer rows with their churn and revenue results where there are any.

    A run number belongs to one tenant, so joining on the tenant as well changes
    no row; it keeps tenants apart and lets a tenant filter reach every scan.
    """
    x = churn.select(*ROW_KEY, "churn_probability", "risk_level", "days_since_last_purchase")
    r = revenue.select(*ROW_KEY, "total_revenue", "predicted_revenue", "revenue_segment", "avg_transaction_value")
    return customers.join(x, ROW_KEY, "left").join(r, ROW_KEY, "left")


def dashboard_join(customers: DataFrame, history: DataFrame, churn: DataFrame, revenue: DataFrame) -> DataFrame:
    """The 18-column dashboard rows; history, churn and revenue may be missing."""
    stamps = history.select(*RUN_KEY, F.col("timestamp").alias("created_at"))
    return with_results(customers, churn, revenue).join(stamps, RUN_KEY, "left").select(
        "analysis_id", "user_id", "customer_id", "customer_name", "age", "gender", "country", "total_revenue",
        "predicted_revenue", "churn_probability", "risk_level", "revenue_segment", "transaction_count",
        "avg_transaction_value", "first_purchase_date", "last_purchase_date", "days_since_last_purchase", "created_at",
    )


def dashboard_join_inner(customers: DataFrame, history: DataFrame, churn: DataFrame, revenue: DataFrame) -> DataFrame:
    """The 15-column variant: rows of runs without history are left out."""
    stamps = history.select(*RUN_KEY, F.col("timestamp").alias("analysis_date"))
    return with_results(customers, churn, revenue).join(stamps, RUN_KEY).select(
        "customer_id", "age", "gender", "country", "total_spent", "transaction_count", "first_purchase_date",
        "last_purchase_date", "risk_level", "churn_probability", "revenue_segment", "predicted_revenue",
        "analysis_id", "user_id", "analysis_date",
    )


def owned_children(children: DataFrame, history: DataFrame, user_id: str, analysis_id) -> DataFrame:
    """Child rows of a run, empty unless the tenant owns that run."""
    mine = history.where((F.col("user_id") == F.lit(user_id)) & (F.col("analysis_id") == F.lit(analysis_id)))
    return children.where(F.col("analysis_id") == F.lit(analysis_id)).join(
        mine.select("user_id", "analysis_id"), ["user_id", "analysis_id"], "left_semi"
    )


def without_runs(children: DataFrame, doomed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Child rows that survive the deletion of the ``doomed`` runs or tenants."""
    keys = keys or ["analysis_id"]
    return children.join(doomed.select(*keys).distinct(), keys, "left_anti")
