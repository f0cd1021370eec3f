"""Attempt limiter: at most three recorded attempts per key in five minutes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patronage.session import materialize

# The window and how many attempts it admits.
WINDOW_SECONDS = 300
LIMIT = 3
#: Rows of a block of a burst at least, and how many blocks a burst is to have at most; blocks grow with the burst, up to 16 times.
BLOCK_ROWS, BLOCKS = 250_000, 64
#: Times that blocks are walked again at once before what still differs is walked in turn.
ROUNDS = 2


def admit(times: np.ndarray, live: list[int], span: int, limit: int = LIMIT) -> tuple[np.ndarray, list[int]]:
    """Which of the sorted ``times`` are admitted, and the stamps still remembered.

    Refused attempts are not remembered. While the window is full everything up
    to the moment its oldest stamp expires is refused, so the loop jumps there:
    it takes one step per admitted attempt, not per attempt.
    """
    admitted = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        live = [t for t in live if times[i] - t < span]
        if len(live) >= limit:
            i = int(np.searchsorted(times, live[0] + span, side="left"))
            continue
        admitted[i] = True
        live.append(int(times[i]))
        i += 1
    return admitted, live


def _bursts(events: DataFrame, key: str, stamp: str, seconds: int, rows: int) -> DataFrame:
    """Add ``_burst``, runs of attempts with no pause as long as the window, and ``_block``, parts of about ``rows`` of a burst.

    After such a pause nothing is remembered, so bursts are independent.
    Slots keep the window functions small: one row per key and tenth of the
    window; a block is made of whole slots.
    """
    slot = F.window(stamp, f"{max(1, seconds // 10)} seconds").getField("start")
    keyed = events.withColumn("_slot", slot)
    slots = keyed.groupBy(key, "_slot").agg(F.min(stamp).alias("_lo"), F.max(stamp).alias("_hi"), F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy("_slot")
    pause = F.col("_lo") - F.lag("_hi").over(order)
    new = F.coalesce((pause >= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).cast("int"), F.lit(1))
    numbered = slots.withColumn("_new", new).withColumn("_burst", F.sum("_new").over(order))
    of_burst = Window.partitionBy(key, "_burst")
    size = F.least(F.greatest(F.ceil(F.sum("_n").over(of_burst) / BLOCKS), F.lit(rows)), F.lit(16 * rows))
    before = F.sum("_n").over(of_burst.orderBy("_slot")) - F.col("_n")
    numbered = numbered.select(key, "_slot", "_burst", F.call_function("div", before, size).alias("_block"))
    return keyed.join(numbered, [key, "_slot"]).drop("_slot")


def _packed(times: np.ndarray) -> bytes:
    return zlib.compress(np.diff(times, prepend=0).tobytes(), 1)


def _unpacked(block: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(block), np.int64))


def _blocks(work: DataFrame, key: str) -> DataFrame:
    """The blocks of all bursts that have more than one: first and last time, and all times packed in one value."""
    several = work.groupBy(key, "_burst").agg(F.max("_block").alias("_last")).where("_last > 0").select(key, "_burst")
    ids = [key, "_burst", "_block"]
    times = work.select(*ids, "_us").join(several, [key, "_burst"], "left_semi")
    kind = work.schema[key].dataType.simpleString()

    def pack(ident: tuple, block: pa.Table) -> pa.Table:
        us = np.sort(block.column("_us").to_numpy())
        return pa.table({**{c: pa.array([v.as_py()], v.type) for c, v in zip(ids, ident, strict=True)}, "_first": [int(us[0])], "_times": [_packed(us)]})

    return times.groupBy(*ids).applyInArrow(pack, f"{key} {kind}, _burst long, _block long, _first long, _times binary")


def _walked(blocks: DataFrame, key: str, span: int, limit: int) -> DataFrame:
    """``_end``, the stamps remembered after each block that began with the stamps ``_start``."""
    kind = blocks.schema[key].dataType.simpleString()
    names = [key, "_burst", "_block", "_first", "_start"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, packed = batch.column("_start").to_pylist(), batch.column("_times").to_pylist()
            ends = [admit(_unpacked(t), list(s), span, limit)[1] for s, t in zip(starts, packed, strict=True)]
            columns = [batch.column(c) for c in names] + [pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_end"])

    return blocks.select(*names, "_times").mapInArrow(
        walk, f"{key} {kind}, _burst long, _block long, _first long, _start array<bigint>, _end array<bigint>"
    )


def _walked_in_turn(blocks: DataFrame, key: str, span: int, limit: int) -> DataFrame:
    """The same with each burst's blocks one after the other in one task, which holds a block at a time."""
    kind = blocks.schema[key].dataType.simpleString()
    names = [key, "_burst", "_block", "_first"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        burst, live = None, []
        for batch in batches:
            starts, ends = [], []
            for k, b, first, packed in zip(batch.column(0), batch.column(1), batch.column(3), batch.column(4), strict=True):
                if (k, b) != burst:
                    burst, live = (k, b), []
                starts.append([t for t in live if first.as_py() - t < span])
                live = admit(_unpacked(packed.as_py()), list(starts[-1]), span, limit)[1]
                ends.append(live)
            stamps = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *stamps], [*names, "_start", "_end"])

    ordered = blocks.select(*names, "_times").repartition(key, "_burst").sortWithinPartitions(key, "_burst", "_block")
    return ordered.mapInArrow(walk, f"{key} {kind}, _burst long, _block long, _first long, _start array<bigint>, _end array<bigint>")


def _starts(blocks: DataFrame, key: str, span: int, limit: int) -> DataFrame:
    """The stamps remembered at the start of every block: speculate, then repair.

    All blocks are first walked at once as if nothing were remembered. A block
    whose left neighbour ends with other stamps than it began with is walked
    again from those, all such blocks at once: what is remembered usually
    agrees again within a block. Where attempts are so dense and regular that
    it does not, after ``ROUNDS`` rounds, that burst's blocks are walked in
    turn. A walk takes one step per admitted attempt and reads packed times only.
    """
    ids, burst = [key, "_burst", "_block"], [key, "_burst"]
    nothing = F.array().cast("array<bigint>")
    state = materialize(_walked(blocks.withColumn("_start", nothing), key, span, limit), "limiter-blocks")
    before = Window.partitionBy(*burst).orderBy("_block")
    for left in range(ROUNDS, -1, -1):
        due = state.withColumn("_due", F.filter(F.coalesce(F.lag("_end").over(before), nothing), lambda t: F.col("_first") - t < span))
        again = materialize(due.where("_due <> _start").select(*ids, F.col("_due").alias("_start")), "limiter-again")
        if again.isEmpty():
            break
        if left:
            mended = _walked(blocks.join(again, ids), key, span, limit)
            state = materialize(state.join(again.select(*ids), ids, "left_anti").unionByName(mended), "limiter-blocks")
        else:
            bursts = again.select(*burst).distinct()
            mended = _walked_in_turn(blocks.join(bursts, burst, "left_semi"), key, span, limit)
            state = materialize(state.join(bursts, burst, "left_anti").unionByName(mended), "limiter-blocks")
    return state.select(*ids, "_start")


def limit_attempts(
    events: DataFrame, key: str, stamp: str, tie: str, seconds: int = WINDOW_SECONDS, limit: int = LIMIT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``allowed`` to every attempt, in time order per key (``tie`` breaks equal times).

    An attempt without key or time cannot be judged: it stays, with a null.
    Bursts are judged apart, and a long burst in blocks that are spread over the
    tasks, each from the stamps remembered at its start (see ``_starts``).
    A task walks its sorted rows batch by batch, so no block is held in memory.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))
    known = F.col(key).isNotNull() & F.col(stamp).isNotNull()
    ids = [key, "_burst", "_block"]
    work = _bursts(events.where(known), key, stamp, seconds, block_rows).withColumn("_us", micros)
    if events.where(known).count() > block_rows:
        work = materialize(work, "limiter-bursts")
        blocks = materialize(_blocks(work, key), "limiter-times")
        work = work.join(_starts(blocks, key, span, limit).hint("merge"), ids, "left")
    else:  # no burst can have two blocks
        work = work.withColumn("_start", F.lit(None).cast("array<bigint>"))
    work = work.repartition(*ids).sortWithinPartitions(*ids, "_us", tie)
    names = events.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group, live = None, []
        for pdf in batches:
            flags = np.zeros(len(pdf), dtype=bool)
            columns, times, starts = [pdf[c].to_numpy() for c in ids], pdf["_us"].to_numpy(), pdf["_start"].to_numpy()
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds = [0, *edges.tolist(), len(pdf)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                group = tuple(c[a] for c in columns)
                if group != open_group:
                    open_group, live = group, [] if starts[a] is None else [int(t) for t in starts[a]]
                flags[a:b], live = admit(times[a:b], live, span, limit)
            yield pdf[names].assign(allowed=flags)

    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    unjudged = events.where(~known).withColumn("allowed", F.lit(None).cast("boolean"))
    return work.mapInPandas(walk, schema).unionByName(unjudged)


def stream_limit_attempts(
    events: DataFrame, key: str, stamp: str, tie: str, seconds: int = WINDOW_SECONDS, limit: int = LIMIT, delay: str = "10 minutes"
) -> DataFrame:
    """Admitted and refused attempts with their number ``tie``, decided in the order of their times.

    An attempt waits in the state until the watermark has passed it, so one
    that arrives late, but within ``delay``, still takes its place. The state
    is what waits and at most ``limit`` remembered stamps. Attempts without
    key or time are left to the batch form; later than ``delay`` ones are
    dropped by the watermark.
    """
    span = seconds * 1_000_000
    timed = events.where(F.col(stamp).isNotNull()).select(F.col(key), F.col(tie).cast("long").alias("_id"), F.col(stamp).cast("timestamp").alias("_ts"))
    timed = timed.withWatermark("_ts", delay)

    def step(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(group[0]):  # no key to judge by; a closing row, for one
            return
        live, times, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for b in batches:
                times += b["_ts"].astype("datetime64[us]").astype("int64").tolist()
                ids += b["_id"].tolist()
        order = sorted(range(len(times)), key=lambda i: (times[i], ids[i]))
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [i for i in order if times[i] < passed]
        done = np.array([times[i] for i in ready], np.int64)
        flags, live = admit(done, live, span, limit)
        waiting = order[len(ready):]
        if waiting:
            state.update((live, [times[i] for i in waiting], [ids[i] for i in waiting]))
            state.setTimeoutTimestamp(max(times[waiting[0]] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif any(passed - t < span for t in live):
            state.update((live, [], []))
            state.setTimeoutTimestamp(max((live[-1] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({
            key: [group[0]] * len(ready), tie: [ids[i] for i in ready], "ts": pd.to_datetime(done, unit="us"), "allowed": flags,
        })

    kind = events.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {tie} long, ts timestamp_ntz, allowed boolean", "live array<long>, times array<long>, ids array<long>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
