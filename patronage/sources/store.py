"""Run store: Parquet tables partitioned by tenant and run.

A run becomes visible when its history row is written, which happens last;
readers join to the history, so a half-written run is never seen. Deleting
goes the other way round: history first, then the child partitions.
"""

from __future__ import annotations

import datetime as dt
import secrets
import time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from patronage.operators import cells, cleaning, joins, mapping, runs
from patronage.operators.models import Fitted
from patronage.session import delete_path, path_exists

# Layouts of the stored tables. A run's total grows with its customers, so it has more digits than their amounts.
SCHEMAS = {
    "analysis_history": "timestamp timestamp_ntz, total_customers int, high_risk_customers int, "
    "total_predicted_revenue decimal(28,2), avg_predicted_revenue decimal(15,2), analysis_summary string",
    "churn_data": "customer_id string, churn_probability decimal(5,4), risk_level string, total_amount decimal(15,2), "
    "transaction_count int, days_since_last_purchase int, last_activity date",
    "revenue_data": "customer_id string, predicted_revenue decimal(15,2), total_revenue decimal(15,2), "
    "revenue_segment string, transaction_count int, avg_transaction_value decimal(15,2)",
    "customer_data": "customer_id string, customer_name string, age int, gender string, country string, "
    "total_spent decimal(15,2), transaction_count int, first_purchase_date date, last_purchase_date date",
    "dashboard_cells": "country string, gender string, revenue_segment string, risk_level string, last_purchase_date date, "
    "customers long, total_revenue double",
}
RUN_COLUMNS = "user_id string, analysis_id long"
USERS_SCHEMA = "email string, username string, subscription string, role string, created_at timestamp_ntz"
LOG_SCHEMA = "event_type string, email string, details string, timestamp timestamp_ntz, day date"
CHILDREN = ["customer_data", "churn_data", "revenue_data"]
HISTORY = "analysis_history"
#: What goes with a run beside its children: the dashboard's totals and the trained models.
CELLS, MODELS = "dashboard_cells", "models"


def new_run_id(at: dt.datetime) -> int:
    """A run number that grows with time and does not collide within a millisecond."""
    millis = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return (millis << 20) | secrets.randbits(20)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- reading ---------------------------------------------------------------

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(f"{SCHEMAS[table]}, {RUN_COLUMNS}")

    def _folder(self, name: str, user_id: str | None = None, analysis_id: int | None = None) -> str:
        path = self._path(name)
        if user_id is not None:
            escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            path += f"/user_id={escape(user_id)}"
            if analysis_id is not None:
                path += f"/analysis_id={analysis_id}"
        return path

    def table(self, name: str, user_id: str | None = None, analysis_id: int | None = None) -> DataFrame:
        """Rows on file, including those of runs without a history row.

        With a tenant (and run) only that folder is listed: the cost of one
        tenant's read does not grow with the number of tenants.
        """
        schema, folder = self._schema(name), self._folder(name, user_id, analysis_id)
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._path(name)).parquet(folder)

    def rows(self, name: str, user_id: str | None = None) -> DataFrame:
        """Rows of finished runs, of one tenant or of all."""
        df, history = self.table(name, user_id), self.table(HISTORY, user_id)
        if name == HISTORY:
            return df
        key = ["user_id", "analysis_id"]
        return df.join(history.select(*key), key, "left_semi")

    def run_rows(self, name: str, user_id: str, analysis_id: int) -> DataFrame:
        """One run's rows, read from its partition only."""
        mine = (user_id, analysis_id)
        return joins.owned_children(self.table(name, *mine), self.table(HISTORY, *mine), *mine)

    # --- writing ---------------------------------------------------------------

    def _append(self, name: str, df: DataFrame, user_id: str, analysis_id: int) -> None:
        """Write a run's rows straight into its own folder: writers of other runs share no commit folder with it."""
        rows = conform(df, self._schema(name)).drop("user_id", "analysis_id").hint("rebalance")
        rows.write.mode("append").parquet(self._folder(name, user_id, analysis_id))

    def load(self, name: str, df: DataFrame) -> None:
        """Fill a table of a new store with rows of many runs at once; not for a store in use."""
        rows = conform(df, self._schema(name)).hint("rebalance", "user_id", "analysis_id")
        rows.write.partitionBy("user_id", "analysis_id").parquet(self._path(name))

    def _drop_run(self, name: str, user_id: str, analysis_id=None) -> None:
        delete_path(self.spark, self._folder(name, user_id, analysis_id))

    def append_results(self, user_id: str, analysis_id: int, churn: DataFrame, revenue: DataFrame, as_of) -> None:
        """Append churn and revenue rows of a run: both or neither."""
        churn = self._prepare_churn(churn, user_id, as_of).withColumn("analysis_id", F.lit(analysis_id))
        revenue = cleaning.for_tenant(mapping.strip_names(revenue), user_id).withColumn("analysis_id", F.lit(analysis_id))
        cleaning.require_rows(churn, revenue, message=f"no rows for {user_id}")
        try:
            self._append("churn_data", mapping.keep_columns(churn, mapping.CHURN_COLUMNS), user_id, analysis_id)
            self._append("revenue_data", mapping.keep_columns(revenue, mapping.REVENUE_COLUMNS), user_id, analysis_id)
        except Exception:
            for name in ("churn_data", "revenue_data"):
                self._drop_run(name, user_id, analysis_id)
            raise

    def _prepare_churn(self, churn: DataFrame, user_id: str, as_of) -> DataFrame:
        df = cleaning.for_tenant(mapping.strip_names(churn), user_id)
        df = cleaning.last_activity_day(mapping.prefer_final_probability(df))
        return cleaning.days_as_integer(df, as_of)

    def save_run(
        self, user_id: str, churn: DataFrame, revenue: DataFrame, customers: DataFrame, at: dt.datetime,
        models: dict[str, Fitted] | None = None,
    ) -> int:
        """Store a run at customer grain, with its trained models by kind, and return its number.

        Children and models first, the history row last: that row is the
        commit. The frames are read a few times, so pass tables or written stages.
        """
        run = new_run_id(at)
        p = "churn_probability_final" if "churn_probability_final" in churn.columns else "churn_probability"
        try:
            self.append_results(user_id, run, churn, revenue, at)
            people = mapping.stamp_run(customers, user_id, run)
            self._append("customer_data", mapping.keep_columns(people, mapping.CUSTOMER_COLUMNS), user_id, run)
            written = [self.table(name, user_id, run) for name in CHILDREN]
            self._append(CELLS, cells.run_cells(joins.with_results(written[0], written[1], written[2])), user_id, run)
            for kind, fitted in (models or {}).items():
                fitted.write().save(f"{self._folder(MODELS, user_id, run)}/{kind}")
            totals = runs.run_totals(mapping.stamp_run(churn, user_id, run), mapping.stamp_run(revenue, user_id, run), p)
            self._append(HISTORY, totals.withColumn("timestamp", F.lit(at).cast("timestamp_ntz")), user_id, run)
        except Exception:
            for name in (*CHILDREN, CELLS, MODELS):
                self._drop_run(name, user_id, run)
            raise
        return run

    # --- models of a run ------------------------------------------------------------

    def load_model(self, user_id: str, analysis_id: int, kind: str) -> Fitted:
        """The model of one of the tenant's finished runs."""
        path = f"{self._folder(MODELS, user_id, analysis_id)}/{kind}"
        if self.table(HISTORY, user_id, analysis_id).isEmpty() or not path_exists(self.spark, path):
            raise LookupError(f"no {kind} model of run {analysis_id}")
        return Fitted.read().load(path)

    # --- history, retention, deletion ---------------------------------------------

    def history(self, user_id: str) -> DataFrame:
        return runs.history_listing(self.table(HISTORY, user_id), user_id)

    def details(self, user_id: str, analysis_id: int) -> dict[str, DataFrame]:
        """Three child projections of a run, empty unless the tenant owns it."""
        picks = {
            "churn_data": ["customer_id", "churn_probability", "risk_level", "total_amount", "transaction_count"],
            "revenue_data": ["customer_id", "predicted_revenue", "total_revenue", "revenue_segment",
                             "transaction_count", "avg_transaction_value"],
            "customer_data": ["customer_id", "age", "gender", "country", "total_spent", "transaction_count"],
        }
        return {n: self.run_rows(n, user_id, analysis_id).select(*cols) for n, cols in picks.items()}

    def delete_run(self, user_id: str, analysis_id: int) -> bool:
        """Delete a run of the tenant; False if it has none of that number."""
        if self.table(HISTORY, user_id, analysis_id).isEmpty():
            return False
        for name in (HISTORY, *CHILDREN, CELLS, MODELS):
            self._drop_run(name, user_id, analysis_id)
        return True

    def cleanup(self, user_id: str, as_of) -> list[int]:
        """Delete the tenant's expired runs: a few partitions, found in its history."""
        old = runs.expired_runs(self.table(HISTORY, user_id), as_of).select("analysis_id")
        doomed = sorted(r["analysis_id"] for r in old.collect())  # one tenant's runs, bounded by its quota
        for run in doomed:
            for name in (HISTORY, *CHILDREN, CELLS, MODELS):
                self._drop_run(name, user_id, run)
        return doomed

    def delete_tenant(self, user_id: str, at: dt.datetime) -> None:
        """Delete everything of a tenant, its account row too, and log that."""
        for name in (HISTORY, *CHILDREN, CELLS, MODELS):
            self._drop_run(name, user_id)
        self._change_users(lambda users: users.where(F.col("email") != user_id))
        self.log_event("DELETE_ACCOUNT", user_id, "User deleted their account and all data.", at)

    # --- users ----------------------------------------------------------------------

    def _user_versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/users/version=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def users(self) -> DataFrame:
        versions = self._user_versions()
        if not versions:
            return self.spark.createDataFrame([], USERS_SCHEMA)
        return self.spark.read.schema(USERS_SCHEMA).parquet(f"{self.root}/users/version={versions[-1]}")

    def _change_users(self, change, wait: float = 60.0) -> None:
        """Write what ``change`` makes of the users as a new complete version.

        A writer first claims the next number with a file that only one can
        create; another waits until that version is there and then starts from
        it, so no change is lost. The last two versions are kept, so running
        readers finish. A claim whose writer died ends the wait with an error.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        end = time.monotonic() + wait
        while True:
            versions = self._user_versions()
            number = versions[-1] + 1 if versions else 1
            claim = hadoop.Path(f"{self.root}/users/claim-{number}")
            if claim.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(claim):
                break
            if time.monotonic() > end:
                raise TimeoutError(f"version {number} of the users is claimed and not written; remove {claim} if its writer is gone")
            time.sleep(0.2)
        try:
            change(self.users()).write.parquet(f"{self.root}/users/version={number}")
        except Exception:
            delete_path(self.spark, f"{self.root}/users/version={number}")
            delete_path(self.spark, str(claim))
            raise
        for old in versions[:-1]:
            delete_path(self.spark, f"{self.root}/users/version={old}")

    def upsert_users(self, incoming: DataFrame) -> None:
        incoming = conform(incoming, T.StructType.fromDDL(USERS_SCHEMA))
        self._change_users(lambda users: runs.upsert(users, incoming, ["email"], "created_at"))

    def quota(self, user_id: str, day: dt.date) -> dict:
        """Runs used on a day, whether one more is allowed, and how many remain; none without an account."""
        plan = self.users().where(F.col("email") == user_id).select("subscription", "role").first()
        used = self.table(HISTORY, user_id).where(F.to_date("timestamp") == F.lit(day)).count()
        if plan is None:
            return {"runs": used, "allowed": False, "remaining": 0}
        plan_name = plan["subscription"] or runs.DEFAULT_PLAN
        role = plan["role"] or runs.DEFAULT_ROLE
        if role == runs.UNLIMITED_ROLE or plan_name == runs.UNLIMITED_PLAN:
            return {"runs": used, "allowed": True, "remaining": None}
        return {"runs": used, "allowed": used < runs.FREE_RUNS_PER_DAY, "remaining": max(runs.FREE_RUNS_PER_DAY - used, 0)}

    # --- audit log --------------------------------------------------------------------

    def log_event(self, event_type: str, email: str, details: str, at: dt.datetime) -> None:
        row = [(event_type, email, details, at.replace(tzinfo=None), at.date())]
        df = self.spark.createDataFrame(row, LOG_SCHEMA)
        df.write.mode("append").partitionBy("day").parquet(f"{self.root}/security_log")

    def append_events(self, events: DataFrame) -> None:
        """Append many audit events at once, one folder per day."""
        stamped = events.withColumn("day", F.to_date("timestamp"))
        out = conform(stamped, T.StructType.fromDDL(LOG_SCHEMA)).hint("rebalance", "day")
        out.write.mode("append").partitionBy("day").parquet(f"{self.root}/security_log")

    def events(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/security_log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/security_log")

    # --- dashboard ----------------------------------------------------------------------

    def dashboard(self, user_id: str | None = None, inner: bool = False) -> DataFrame:
        """Dashboard rows of finished runs."""
        parts = [self.table(n, user_id) for n in ("customer_data", HISTORY, "churn_data", "revenue_data")]
        if inner:
            return joins.dashboard_join_inner(*parts)
        return joins.dashboard_join(*parts).where("created_at is not null")

    def latest_cells(self, user_id: str) -> DataFrame:
        """The dashboard's totals of the tenant's newest finished run."""
        newest = self.table(HISTORY, user_id).agg(F.max("analysis_id").alias("id")).first()["id"]
        return self.run_rows(CELLS, user_id, newest if newest is not None else -1)

    def create_view(self, name: str = "full_dashboard_data") -> None:
        self.dashboard().createOrReplaceTempView(name)

    def latest(self, user_id: str) -> DataFrame:
        """Dashboard rows of the tenant's newest run; none for an unknown tenant."""
        if self.users().where(F.col("email") == user_id).isEmpty():
            return self.dashboard(user_id).limit(0)
        newest = self.table(HISTORY, user_id).agg(F.max("analysis_id").alias("id")).first()["id"]
        rows = self.dashboard(user_id)
        # The literal run number prunes partitions under the whole join.
        return rows.where(F.col("analysis_id") == F.lit(newest)) if newest is not None else rows.limit(0)


def profile(df: DataFrame, tenant: str = "user_id") -> DataFrame:
    """Rows and distinct tenants of a table."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(tenant).alias("tenants"))


def recent_runs(history: DataFrame, n: int = 5) -> DataFrame:
    return history.select("user_id", "analysis_id", "timestamp").orderBy(F.desc("timestamp"), F.desc("analysis_id"), "user_id").limit(n)
