"""CSV readers and writers with fixed or inferred types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The two typed layouts.
CUSTOMER_SCHEMA = "customer_id long, gender string, age long, country string, signup_date string"
TRANSACTION_SCHEMA = "transaction_id string, customer_id long, amount double, date string, category string"


def _typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # FAILFAST: a bad number ends the read instead of turning into null.
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("mode", "FAILFAST").csv(path)


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, CUSTOMER_SCHEMA)


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, TRANSACTION_SCHEMA)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header; types are inferred, which reads the file once more."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with a CSV of all rows, one part file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def active_customers(customers: DataFrame) -> DataFrame:
    """The customer master columns of active customers."""
    return customers.where("is_active").select(
        "customer_id", "first_purchase_date", "last_purchase_date", "total_orders", "total_spend",
        "avg_order_value", "days_since_last_purchase", "preferred_category",
    )


def transactions_since(transactions: DataFrame, since) -> DataFrame:
    """Transactions from a date on; the filter reaches the scan."""
    return transactions.where(F.col("transaction_date") >= F.lit(since)).select(
        "customer_id", "transaction_date", "amount", "category", "payment_method"
    )
