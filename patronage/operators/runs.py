"""Set operations on stored runs: summaries, history, quota, retention, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from patronage.functions.scalar import instant
from patronage.operators.joins import without_runs
from patronage.operators.reports import newest_per_key
from patronage.operators.rollups import total

# Retention, quota, plan defaults.
RETENTION_DAYS = 3
FREE_RUNS_PER_DAY = 2
DEFAULT_PLAN, DEFAULT_ROLE = "Free", "user"
UNLIMITED_PLAN, UNLIMITED_ROLE = "Premium", "developer"
HIGH_RISK_CUT = 0.5


def run_totals(churn: DataFrame, revenue: DataFrame, p: str = "churn_probability") -> DataFrame:
    """Per run: customers, rows with p > .5, predicted sum and mean, a text.

    Both sides shrink to one row per run before they meet.
    """
    key = ["user_id", "analysis_id"]
    c = churn.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col(p) > HIGH_RISK_CUT).alias("high_risk_customers"),
    )
    r = revenue.groupBy(*key).agg(
        total("predicted_revenue").alias("total_predicted_revenue"),
        F.avg("predicted_revenue").alias("avg_predicted_revenue"),
    )
    text = F.format_string("Analysis completed for %d customers.", F.col("total_customers"))
    return c.join(r, key, "left").withColumn("analysis_summary", text)


def history_listing(history: DataFrame, user_id: str) -> DataFrame:
    """A tenant's runs, newest first; missing sums read 0."""
    return (
        history.where(F.col("user_id") == F.lit(user_id))
        .select(
            "analysis_id", "timestamp", "total_customers", "high_risk_customers",
            F.coalesce(F.col("total_predicted_revenue").cast("double"), F.lit(0.0)).alias("total_predicted_revenue"),
            F.coalesce(F.col("avg_predicted_revenue").cast("double"), F.lit(0.0)).alias("avg_predicted_revenue"),
            "analysis_summary",
        )
        .orderBy(F.desc("timestamp"), F.desc("analysis_id"))
    )


def expired_runs(history: DataFrame, as_of, days: int = RETENTION_DAYS, user_id: str | None = None) -> DataFrame:
    """Runs strictly older than the retention, of one tenant or of all."""
    old = history.where(F.col("timestamp") < instant(as_of) - F.make_dt_interval(F.lit(days)))
    return old if user_id is None else old.where(F.col("user_id") == F.lit(user_id))


def retain(history: DataFrame, children: list[DataFrame], as_of, days: int = RETENTION_DAYS) -> list[DataFrame]:
    """History and child tables without the expired runs."""
    old = expired_runs(history, as_of, days)
    return [without_runs(t, old, ["user_id", "analysis_id"]) for t in (history, *children)]


def plan_lookup(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Plan and role per tenant; unknown tenants get the defaults."""
    plans = users.select(F.col("email").alias("user_id"), "subscription", "role")
    return keys.join(plans, "user_id", "left").withColumns(
        {
            "subscription": F.coalesce("subscription", F.lit(DEFAULT_PLAN)),
            "role": F.coalesce("role", F.lit(DEFAULT_ROLE)),
        }
    )


def daily_quota(history: DataFrame, users: DataFrame) -> DataFrame:
    """Runs of each tenant and day against the plan's limit; a tenant without an account gets none."""
    used = history.groupBy("user_id", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("runs"))
    free = (F.col("role") != UNLIMITED_ROLE) & (F.col("subscription") != UNLIMITED_PLAN)
    known = F.col("_known").isNotNull()
    left = F.when(~known, F.lit(0).cast("long")).when(free, F.greatest(F.lit(FREE_RUNS_PER_DAY) - F.col("runs"), F.lit(0)))
    accounts = users.select(F.col("email").alias("user_id"), F.lit(True).alias("_known"))
    return plan_lookup(used, users).join(accounts, "user_id", "left").withColumns(
        {"allowed": known & (~free | (F.col("runs") < FREE_RUNS_PER_DAY)), "remaining": left}
    ).drop("_known")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order_by: str | None = None) -> DataFrame:
    """Rows of ``existing`` with those of ``incoming`` put in or in their place.

    The incoming side is reduced to one row per key first, the same one in
    every run; keys of the existing side are unique already, so nothing is
    sorted.
    """
    new = newest_per_key(incoming, key, order_by)
    new = new.select(*existing.columns)
    return existing.join(new.select(*key), key, "left_anti").select(*existing.columns).unionByName(new)


def event_report(events: DataFrame, window: str = "1 day", stamp: str = "timestamp") -> DataFrame:
    """Events per type and time window."""
    return (
        events.groupBy(F.window(stamp, window).alias("_w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("_w.start").alias("window_start"), "event_type", "events")
    )
