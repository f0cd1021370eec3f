"""Retention horizon in batch and on a stream, and running a finite stream to its end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from patronage.functions.scalar import instant
from patronage.operators.runs import RETENTION_DAYS
from patronage.session import delete_path, list_folders, scratch_path


def within_retention(rows: DataFrame, as_of, stamp: str = "ts", days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than the horizon; a row exactly at it stays."""
    return rows.where(F.col(stamp) >= instant(as_of) - F.make_dt_interval(F.lit(days)))


class RetainedRows:
    """A table that a stream fills and that holds only rows up to ``days`` behind the newest one.

    The horizon follows the newest event time seen, across batches and
    restarts; ``rows`` reads exactly the rows within it. Rows are kept in folders
    by day and batch: a whole day past the horizon is dropped as folders, with
    no row read or rewritten, and a batch that is run again after a failure
    replaces its own folders instead of adding to them. Rows that come late
    but within the horizon are kept, later ones and rows without a time never
    enter the table.
    """

    DAY, BATCH = "_day", "_batch"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, stamp: str = "ts", days: int = RETENTION_DAYS):
        self.spark, self.path, self.schema, self.stamp, self.days = spark, path.rstrip("/"), schema, stamp, days

    def _newest(self, before: int | None = None) -> dt.datetime | None:
        """The newest time of all batches, or of those before a batch: each batch leaves the mark it has reached."""
        marks = [int(m.removeprefix("batch=")) for m in list_folders(self.spark, f"{self.path}/marks")]
        marks = [m for m in marks if before is None or m < before]
        if not marks:
            return None
        return self.spark.read.schema("newest timestamp_ntz").parquet(f"{self.path}/marks/batch={max(marks)}").first()["newest"]

    def _absorb(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = batch.agg(F.max(F.col(self.stamp).cast("timestamp_ntz")).alias("newest")).first()["newest"]
        newest = max(filter(None, (seen, self._newest(number))), default=None)
        if newest is None:
            return
        kept = within_retention(batch, newest, self.stamp, self.days)
        kept = kept.withColumns({self.DAY: F.col(self.stamp).cast("date"), self.BATCH: F.lit(number)}).hint("rebalance", self.DAY)
        (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.DAY, self.BATCH).parquet(f"{self.path}/rows"))
        mark = spark.range(1).select(F.lit(newest).cast("timestamp_ntz").alias("newest")).coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")
        self._drop_days(newest)
        for old in list_folders(self.spark, f"{self.path}/marks"):
            if int(old.removeprefix("batch=")) < number - 1:  # the last two serve a batch that is run again
                delete_path(self.spark, f"{self.path}/marks/{old}")

    def _drop_days(self, newest: dt.datetime) -> None:
        first = (newest - dt.timedelta(days=self.days)).date().isoformat()
        for folder in list_folders(self.spark, f"{self.path}/rows"):
            if folder.startswith(f"{self.DAY}=") and folder.removeprefix(f"{self.DAY}=") < first:
                delete_path(self.spark, f"{self.path}/rows/{folder}")

    def absorb(self, stream: DataFrame) -> None:
        """Take in what the stream has now; a later call goes on where this one ended."""
        query = (
            stream.writeStream.foreachBatch(self._absorb).option("checkpointLocation", f"{self.path}/progress")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def rows(self) -> DataFrame:
        """The rows within the horizon."""
        newest = self._newest()
        if newest is None or not list_folders(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        parts = T.StructType([*self.schema.fields, T.StructField(self.DAY, T.DateType()), T.StructField(self.BATCH, T.LongType())])
        first = (newest - dt.timedelta(days=self.days)).date()
        stored = self.spark.read.schema(parts).parquet(f"{self.path}/rows").where(F.col(self.DAY) >= F.lit(first))
        return within_retention(stored, newest, self.stamp, self.days).select(*self.schema.names)


def stream_daily_counts(events: DataFrame, stamp: str = "ts", days: int = RETENTION_DAYS) -> DataFrame:
    """Events per day and type; rows older than the horizon behind the newest of earlier batches are dropped.

    Rows without a type are not counted.
    """
    timed = events.withColumn("_ts", F.col(stamp).cast("timestamp")).withWatermark("_ts", f"{days} days")
    return (
        timed.groupBy(F.window("_ts", "1 day").alias("_w"), "event_type")
        .agg(F.count("event_type").alias("events"))
        .where("events > 0")  # on the type itself it would be moved below the watermark
        .select(F.col("_w.start").cast("date").alias("day"), "event_type", "events")
    )


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def with_closing(stream: DataFrame, stamp: str, tag: str) -> tuple[DataFrame, str]:
    """The stream joined with a folder of closing rows, in which all but the time is null.

    A closing row beyond all others carries the watermark past every open
    group; see ``run_to_end``. Consumers must leave rows with a null key out.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, f"{tag}-closing")
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    closing = spark.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(closing), folder


def close_with(spark: SparkSession, schema: T.StructType, stamp: str, folder: str, at) -> None:
    """Put a closing row at the time ``at`` into the folder of ``with_closing``."""
    row = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == stamp else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(folder)


def run_to_end(stream: DataFrame, tag: str, close=None) -> DataFrame:
    """Process what is there, write it as a table in the shared folder, read that back.

    ``close`` is called when all input has been read, to add a closing row;
    the query then goes on from its checkpoint and gives out what was open.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, tag)
    for last in (False, True):
        if last:
            if close is None:
                break
            close()
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{path}-progress")
            .option("path", path)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
