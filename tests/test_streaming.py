import datetime as dt

import numpy as np
import pytest

from patronage.streaming import limiter, retention, sessions
from tests.conftest import values

T0 = dt.datetime(2024, 1, 1)


def at(*seconds):
    return [T0 + dt.timedelta(seconds=s) for s in seconds]


def test_session_boundary(frame):
    # A pause of exactly thirty minutes continues the session, one second more ends it.
    rows = [(1, t) for t in at(0, 1800, 3601)] + [(2, t) for t in at(10, 20)] + [(None, T0)]
    got = values(sessions.sessions(frame(rows, "user_id long, ts timestamp_ntz")), "user_id", "session_no", "events")
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_brute_force(frame, seed):
    rng = np.random.default_rng(seed)
    stamps = [(int(u), T0 + dt.timedelta(seconds=int(s))) for u, s in zip(rng.integers(0, 4, 300), rng.integers(0, 200_000, 300))]
    want = []
    for u in range(4):
        mine = sorted(t for k, t in stamps if k == u)
        start = last = mine[0]
        n = 0
        for t in mine:
            if (t - last).total_seconds() > 1800:
                want.append((u, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        want.append((u, start, last, n))
    got = values(sessions.sessions(frame(stamps, "user_id long, ts timestamp_ntz")), "user_id", "session_start", "last_event", "events")
    assert got == sorted(want, key=repr)


def brute_limit(times):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if t - k < 300]
        ok = len(kept) < 3
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def test_limiter_refuses_and_does_not_record(frame):
    times = [0, 10, 20, 30, 299, 300, 305, 310, 320]
    rows = [(i, "k", t) for i, t in enumerate(at(*times))]
    got = values(limiter.limit_attempts(frame(rows, "id long, ip string, ts timestamp_ntz"), "ip", "ts", "id"), "id", "allowed")
    assert [ok for _, ok in got] == brute_limit(times)


@pytest.mark.parametrize("spread", [500, 5_000, 100_000])
def test_limiter_equals_brute_force(frame, spread):
    rng = np.random.default_rng(spread)
    rows, want = [], {}
    for key in ("hot", "b", "c"):
        n = 600 if key == "hot" else 60
        times = sorted(int(t) for t in rng.integers(0, spread, n))
        for t, ok in zip(times, brute_limit(times)):
            want[len(rows)] = ok
            rows.append((len(rows), key, at(t)[0]))
    got = dict(values(limiter.limit_attempts(frame(rows, "id long, ip string, ts timestamp_ntz"), "ip", "ts", "id"), "id", "allowed"))
    assert got == want


HOT = {
    "random": lambda rng: np.sort(rng.integers(0, 12_000, 600)),
    "regular": lambda rng: np.arange(600) * 7,  # walks from other stamps never agree again
    "sparse": lambda rng: np.cumsum(rng.integers(90, 250, 600)),  # they agree at once
    "ties": lambda rng: np.sort(rng.integers(0, 60, 600)) * 100,
}


@pytest.mark.parametrize("name", HOT)
@pytest.mark.parametrize("block", [60, 10**6])
def test_a_hot_burst_is_walked_in_blocks(frame, name, block):
    times = [int(t) for t in HOT[name](np.random.default_rng(1))]
    rows = [(i, "hot", at(t)[0]) for i, t in enumerate(times)] + [(10_000 + i, f"k{i % 500}", at(i)[0]) for i in range(1000)]
    df = frame(rows, "id long, ip string, ts timestamp_ntz", 8)
    got = dict(values(limiter.limit_attempts(df, "ip", "ts", "id", block_rows=block), "id", "allowed"))
    assert len(got) == len(rows) and [got[i] for i in range(len(times))] == brute_limit(times)
    if block == 60:
        work = limiter._bursts(df, "ip", "ts", 300, block).where("_block > 0")
        assert {r.ip for r in work.select("ip").distinct().collect()} == {"hot"} and work.select("_block").distinct().count() > 3


def test_retention_edge(frame):
    rows = [(1, T0), (2, T0 - dt.timedelta(days=3)), (3, T0 - dt.timedelta(days=3, seconds=1))]
    assert values(retention.within_retention(frame(rows, "k long, ts timestamp_ntz"), T0), "k") == [(1,), (2,)]


def test_streams_agree_with_batch(spark, frame, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(u), T0 + dt.timedelta(seconds=int(s)), "click") for u, s in zip(rng.integers(0, 3, 200), np.sort(rng.integers(0, 400_000, 200)))]
    schema = "user_id long, ts timestamp_ntz, event_type string"
    folder = str(tmp_path / "events")
    for i in range(4):  # several files: the state is carried from one micro-batch to the next
        spark.createDataFrame(rows[i * 50:(i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(folder)
    batch = frame(rows, schema)
    stream = retention.read_folder(spark, folder, batch.schema)
    last = max(t for _, t, _ in rows)
    every = values(sessions.sessions(batch), "user_id", "session_start", "last_event", "events")
    closed = [r for r in every if r[2] + dt.timedelta(minutes=30) <= last - dt.timedelta(minutes=10)]
    got = retention.run_to_end(sessions.stream_sessions(stream), "t-sessions")
    assert values(got, "user_id", "session_start", "last_event", "events") == closed
    assert values(to_end(spark, stream, sessions.stream_sessions, "t-all"), "user_id", "session_start", "last_event", "events") == every


def to_end(spark, stream, make, tag):
    both, closing = retention.with_closing(stream, "ts", tag)
    return retention.run_to_end(make(both), tag, lambda: retention.close_with(spark, stream.schema, "ts", closing, "2200-06-01 00:00:00"))


def test_stream_limiter_decides_in_time_order(spark, tmp_path):
    # Files arrive as 100, 200 / 50 / 340, 360 seconds: the late 50 takes its place, so 360 is admitted.
    schema = "id long, user_id long, ts timestamp_ntz"
    folder, rows = str(tmp_path / "late"), [(0, 100), (1, 200), (2, 50), (3, 340), (4, 360)]
    for k, part in enumerate((rows[:2], rows[2:3], rows[3:])):
        stamped = [(i, 7, at(s)[0]) for i, s in part]
        spark.createDataFrame(stamped, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = retention.read_folder(spark, folder, spark.read.parquet(folder).schema)
    got = dict(values(to_end(spark, stream, lambda e: limiter.stream_limit_attempts(e, "user_id", "ts", "id"), "t-order"), "id", "allowed"))
    order = sorted(rows, key=lambda r: r[1])
    assert got == dict(zip([i for i, _ in order], brute_limit([s for _, s in order])))


def test_limiter_keeps_what_it_cannot_judge(frame):
    rows = [(1, None, T0), (2, "k", None), (3, "k", T0)]
    got = values(limiter.limit_attempts(frame(rows, "id long, ip string, ts timestamp_ntz"), "ip", "ts", "id"), "id", "allowed")
    assert got == [(1, None), (2, None), (3, True)]


def test_stream_retention_drops_what_is_late(spark, tmp_path):
    # A row four days behind the newest of an earlier file is dropped, one two days behind counts.
    folder, day = str(tmp_path / "days"), dt.timedelta(days=1)
    schema = "user_id long, ts timestamp_ntz, event_type string"
    spark.createDataFrame([(1, T0 + 10 * day, "a")], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = retention.stream_daily_counts(retention.read_folder(spark, folder, spark.read.parquet(folder).schema))
    path, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def go():
        q = stream.writeStream.format("parquet").option("checkpointLocation", progress).option("path", path).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    spark.createDataFrame([(1, T0 + 6 * day, "a"), (1, T0 + 8 * day, "a")], schema).coalesce(1).write.mode("append").parquet(folder)
    go()
    spark.createDataFrame([(1, T0 + 30 * day, "a")], schema).coalesce(1).write.mode("append").parquet(folder)
    go()
    assert values(spark.read.schema(stream.schema).parquet(path), "day", "events") == [
        ((T0 + 10 * day).date(), 1), ((T0 + 8 * day).date(), 1)]  # in the order of their spelling


def arrivals(frame, path, batches):
    """One file per batch, in order."""
    for rows in batches:
        frame(rows, "event_id long, ts timestamp_ntz", 1).write.mode("append").parquet(path)


def test_retained_rows_follow_the_newest_event(spark, frame, tmp_path):
    day, source, schema = 86_400, f"{tmp_path}/in", "event_id long, ts timestamp_ntz"
    batches = [
        list(enumerate(at(0, 10, day))) + [(99, None)],
        [(10, T0 + dt.timedelta(days=3)), (11, T0 + dt.timedelta(days=3, seconds=-1)), (12, T0)],  # the first row is exactly at the horizon
        [(20, T0 + dt.timedelta(days=3, seconds=5)), (21, T0 + dt.timedelta(seconds=6)), (22, T0 + dt.timedelta(seconds=4))],  # late: within, beyond
        [(30, T0 + dt.timedelta(days=9))],
        [(40, T0 + dt.timedelta(days=2)), (41, T0 + dt.timedelta(days=7))],
    ]
    want = [{0, 1, 2}, {0, 1, 2, 10, 11, 12}, {1, 2, 10, 11, 20, 21}, {30}, {30, 41}]
    types = spark.createDataFrame([], schema).schema
    kept = retention.RetainedRows(spark, f"{tmp_path}/kept", types)
    assert kept.rows().count() == 0
    for batch, ids in zip(batches, want, strict=True):
        arrivals(frame, source, [batch])
        kept.absorb(spark.readStream.schema(types).parquet(source))
        assert {r.event_id for r in retention.RetainedRows(spark, f"{tmp_path}/kept", types).rows().collect()} == ids
    days = sorted(p.name for p in (tmp_path / "kept" / "rows").glob("_day=*"))
    assert days == ["_day=2024-01-08", "_day=2024-01-10"]


def test_a_batch_run_again_adds_nothing(spark, frame, tmp_path):
    df = frame([(i, t) for i, t in enumerate(at(0, 5, 9))], "event_id long, ts timestamp_ntz")
    kept = retention.RetainedRows(spark, f"{tmp_path}/kept", df.schema)
    for number in (0, 1, 1, 1):
        kept._absorb(df, number)
    assert kept.rows().count() == 6
    kept._absorb(frame([(7, T0 + dt.timedelta(days=30))], "event_id long, ts timestamp_ntz"), 2)
    assert values(kept.rows(), "event_id") == [(7,)]
    kept._absorb(df.limit(0), 3)
    assert values(kept.rows(), "event_id") == [(7,)]
