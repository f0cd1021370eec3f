"""Inactivity sessions, in batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed value: a longer pause ends the session.
TIMEOUT_MINUTES = 30


def sessions(events: DataFrame, key: str = "user_id", stamp: str = "ts", minutes: int = TIMEOUT_MINUTES) -> DataFrame:
    """Sessions per key: start, last event, number of events.

    Events first shrink to one row per key and time slot as long as the
    timeout. Two events of a slot can never be a timeout apart, so only pauses
    between slots matter, and a key's rows are bounded by the time covered and
    not by its events: a key with a third of all events is no larger than any
    other busy key once the slots are combined on the map side.
    """
    slots = (
        events.where(F.col(key).isNotNull() & F.col(stamp).isNotNull())
        .groupBy(key, F.window(stamp, f"{minutes} minutes").alias("_slot"))
        .agg(F.min(stamp).alias("_lo"), F.max(stamp).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(key).orderBy("_lo")
    pause = F.col("_lo") - F.lag("_hi").over(order)
    timeout = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    starts = F.coalesce((pause > timeout).cast("int"), F.lit(1))
    numbered = slots.withColumn("_new", starts).withColumn("session_no", F.sum("_new").over(order))
    return numbered.groupBy(key, "session_no").agg(
        F.min("_lo").alias("session_start"), F.max("_hi").alias("last_event"), F.sum("_n").alias("events")
    )


def stream_sessions(
    events: DataFrame, key: str = "user_id", stamp: str = "ts", minutes: int = TIMEOUT_MINUTES, delay: str = "10 minutes"
) -> DataFrame:
    """The same sessions on a stream; each is emitted once the watermark has passed it.

    Events without a key are left out, as in batch, but move the watermark, so
    a closing row ends what is open (``retention.run_to_end``).

    Start the query with ``merge_locally(spark)`` so that a hot key's windows
    are merged inside each task before the shuffle.
    """
    timed = events.withColumn("_ts", F.col(stamp).cast("timestamp")).withWatermark("_ts", delay)
    return (
        timed.groupBy(key, F.session_window("_ts", f"{minutes} minutes").alias("_s"))
        .agg(F.max("_ts").alias("last_event"), F.count(key).alias("events"))
        .where("events > 0")  # on the key itself it would be moved below the watermark
        .select(
            key,
            F.col("_s.start").cast("timestamp_ntz").alias("session_start"),
            F.col("last_event").cast("timestamp_ntz").alias("last_event"),
            "events",
        )
    )


def merge_locally(spark) -> None:
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
