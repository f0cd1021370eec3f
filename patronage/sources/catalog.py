"""Runs of all tenants as tables of Spark's catalog, laid out so that they join where they lie.

Customer, churn and revenue rows are bucketed and sorted alike, by tenant, run
and customer. The dashboard's joins then read bucket beside bucket: no row is
shuffled, whatever the tables hold. A run is appended bucket by bucket; the
history row comes last and makes it visible, and rows of runs without one are
left out by every reader until ``compact`` rewrites the tables without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.operators.joins import ROW_KEY, RUN_KEY, dashboard_join

CHILDREN = ("customer_data", "churn_data", "revenue_data")
HISTORY, VIEW = "analysis_history", "full_dashboard_data"
BUCKETS = 64


class RunCatalog:
    """Tables and the dashboard view in one database; ``folder`` is where a new database keeps its files."""

    def __init__(self, spark: SparkSession, database: str, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.database, self.buckets = spark, database, buckets
        place = f" LOCATION '{folder}'" if folder else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    # --- writing ---------------------------------------------------------------------

    def append(self, tables: dict[str, DataFrame]) -> None:
        """Add rows of runs: children first, their history last."""
        for table in (*CHILDREN, HISTORY):
            if table in tables:
                self._write(table, tables[table])

    def _write(self, table: str, rows: DataFrame, mode: str = "append", suffix: str = "") -> None:
        name = self.name(table) + suffix
        if table == HISTORY:
            rows.hint("rebalance").write.mode(mode).format("parquet").saveAsTable(name)
            return
        # A task per bucket, so that each write adds one sorted file to a bucket.
        dealt = rows.repartition(self.buckets, *ROW_KEY)
        dealt.write.mode(mode).format("parquet").bucketBy(self.buckets, *ROW_KEY).sortBy(*ROW_KEY).saveAsTable(name)

    def delete_runs(self, doomed: DataFrame) -> None:
        """Take runs (``user_id``, ``analysis_id``) out of the history; from then on no reader sees their rows."""
        self._replace(HISTORY, self.table(HISTORY).join(doomed.select(*RUN_KEY), RUN_KEY, "left_anti"))

    def compact(self) -> None:
        """Rewrite the children without rows of runs that have no history, one sorted file a bucket."""
        for table in CHILDREN:
            self._replace(table, self.rows(table))

    def _replace(self, table: str, rows: DataFrame) -> None:
        """Put the rows in place of a table that they are read from: written beside it, then renamed."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}_next")
        self._write(table, rows, "errorifexists", "_next")
        self.spark.sql(f"DROP TABLE {self.name(table)}")
        self.spark.sql(f"ALTER TABLE {self.name(table)}_next RENAME TO {self.name(table)}")

    # --- reading ---------------------------------------------------------------------

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def rows(self, table: str) -> DataFrame:
        """Rows of finished runs."""
        rows = self.table(table)
        return rows if table == HISTORY else rows.join(self.table(HISTORY).select(*RUN_KEY), RUN_KEY, "left_semi")

    def dashboard(self) -> DataFrame:
        """The dashboard rows of finished runs; its three joins of children shuffle nothing."""
        customers, churn, revenue = (self.table(t) for t in CHILDREN)
        return dashboard_join(customers, self.table(HISTORY), churn, revenue).where(F.col("created_at").isNotNull())

    def create_view(self) -> None:
        """The dashboard as a permanent view of the database."""
        c, h, x, r = (self.name(t) for t in ("customer_data", HISTORY, "churn_data", "revenue_data"))
        self.spark.sql(
            f"""CREATE OR REPLACE VIEW {self.name(VIEW)} AS
            SELECT c.analysis_id, c.user_id, c.customer_id, c.customer_name, c.age, c.gender, c.country, r.total_revenue, r.predicted_revenue,
              x.churn_probability, x.risk_level, r.revenue_segment, c.transaction_count, r.avg_transaction_value, c.first_purchase_date,
              c.last_purchase_date, x.days_since_last_purchase, h.timestamp AS created_at
            FROM {c} c JOIN {h} h ON c.user_id = h.user_id AND c.analysis_id = h.analysis_id
            LEFT JOIN {x} x ON c.user_id = x.user_id AND c.analysis_id = x.analysis_id AND c.customer_id = x.customer_id
            LEFT JOIN {r} r ON c.user_id = r.user_id AND c.analysis_id = r.analysis_id AND c.customer_id = r.customer_id"""
        )

    # --- what is there -----------------------------------------------------------------

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def columns(self, table: str) -> DataFrame:
        """``place``, ``column_name``, ``data_type`` of a table or view as the catalog lists them."""
        listed = self.spark.catalog.listColumns(self.name(table))
        rows = [(i, c.name, c.dataType) for i, c in enumerate(listed)]
        return self.spark.createDataFrame(rows, "place int, column_name string, data_type string")

    def first_rows(self, table: str, order_by: list, n: int = 5) -> DataFrame:
        return self.table(table).orderBy(*order_by).limit(n)
