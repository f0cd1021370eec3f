"""Time-dependent rules over the event table, in batch and on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.queries.base import EVENTS_AS_OF, query, table
from patronage.session import scratch_path
from patronage.streaming import limiter, retention, sessions

SESSIONS = """gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE
  THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM gaps),
sessions AS (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS last_event,
  count(*) AS events FROM numbered GROUP BY 1, 2)"""


def to_the_end(spark, folder, make, tag):
    """Run ``make`` on the event stream, closing row included, so that nothing stays open."""
    schema = table(spark, folder, "events").schema
    stream, closing = retention.with_closing(retention.read_folder(spark, folder, schema, "events.parquet"), "ts", tag)
    return retention.run_to_end(make(stream), tag, lambda: retention.close_with(spark, schema, "ts", closing, "2200-06-01 00:00:00"))


@query("w1_sessions", f"WITH {SESSIONS} SELECT * FROM sessions")
def w1(spark, folder):
    return sessions.sessions(table(spark, folder, "events"))


@query(
    "w1_stream_sessions",
    f"WITH {SESSIONS} SELECT user_id, session_start, last_event, events FROM sessions",
)
def w1_stream(spark, folder):
    sessions.merge_locally(spark)
    return to_the_end(spark, folder, sessions.stream_sessions, "session-stream")


# An attempt is refused if the third last admitted one is less than the window ago; the recursion walks all keys at once.
ATTEMPTS = """RECURSIVE placed AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
walked AS (SELECT event_id, user_id, ts, place, true AS allowed, ts AS a, NULL::TIMESTAMP AS b, NULL::TIMESTAMP AS c FROM placed WHERE place = 1
  UNION ALL SELECT p.event_id, p.user_id, p.ts, p.place, w.c IS NULL OR p.ts - w.c >= INTERVAL 5 MINUTE,
    CASE WHEN w.c IS NULL OR p.ts - w.c >= INTERVAL 5 MINUTE THEN p.ts ELSE w.a END,
    CASE WHEN w.c IS NULL OR p.ts - w.c >= INTERVAL 5 MINUTE THEN w.a ELSE w.b END,
    CASE WHEN w.c IS NULL OR p.ts - w.c >= INTERVAL 5 MINUTE THEN w.b ELSE w.c END
  FROM walked w JOIN placed p ON p.user_id = w.user_id AND p.place = w.place + 1)"""


@query("w2_limit_attempts", f"WITH {ATTEMPTS} SELECT event_id, ts, user_id, allowed FROM walked")
def w2(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return limiter.limit_attempts(e, "user_id", "ts", "event_id")


# One key has a third of all attempts, twenty times as dense: one burst without a pause.
HOT = """hot AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
  CASE WHEN event_id % 3 = 0 THEN make_timestamp(epoch_us(ts) // 20) ELSE ts END AS ts FROM events)"""


@query(
    "w2_hot_burst",
    "WITH RECURSIVE " + HOT + ", " + ATTEMPTS.removeprefix("RECURSIVE ").replace("FROM events)", "FROM hot)", 1) + " SELECT event_id, ts, user_id, allowed FROM walked",
)
def w2_hot_burst(spark, folder):
    """A hot key's burst in many blocks, which are walked at once and repaired."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    hot = F.col("event_id") % 3 == 0
    e = table(spark, folder, "events").select(
        "event_id", F.when(hot, F.timestamp_micros(F.call_function("div", micros, F.lit(20))).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"),
        F.when(hot, F.lit(-1)).otherwise(F.col("user_id")).cast("long").alias("user_id"),
    )
    return limiter.limit_attempts(e, "user_id", "ts", "event_id", block_rows=100)


@query("w2_stream_limit_attempts", f"WITH {ATTEMPTS} SELECT user_id, event_id, ts, allowed FROM walked")
def w2_stream(spark, folder):
    return to_the_end(spark, folder, lambda e: limiter.stream_limit_attempts(e, "user_id", "ts", "event_id"), "limiter-stream")


@query("w3_retention", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3 DAY")
def w3(spark, folder):
    return retention.within_retention(table(spark, folder, "events").select("event_id", "ts"), EVENTS_AS_OF)


@query(
    "w3_stream_daily_counts",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
)
def w3_stream(spark, folder):
    return to_the_end(spark, folder, retention.stream_daily_counts, "daily-stream")


def in_arrival_files(spark, folder, files=12):
    """The events as files that a stream reads in turn: by time, but with a tenth of the rows up to a week late."""
    late = F.when(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0, F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(7 * 86400))).otherwise(0)
    events = table(spark, folder, "events")
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + late
    path = scratch_path(spark, "arrivals")
    # One write a file, so that their times of writing put them in order.
    span = events.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    file_no = F.floor((arrival - span.lo) * files / (span.hi - span.lo + 1))
    for k in range(files):
        events.where(file_no == k).coalesce(1).write.mode("append").parquet(path)
    return path, events.schema


@query(
    "w3_stream_retention",
    "SELECT event_id, ts, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY",
)
def w3_stream_retention(spark, folder):
    """What is left of all events once a stream of files, late rows among them, has run past the horizon."""
    path, schema = in_arrival_files(spark, folder)
    kept = retention.RetainedRows(spark, scratch_path(spark, "retained"), schema)
    kept.absorb(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path))
    return kept.rows().select("event_id", "ts", "user_id")
