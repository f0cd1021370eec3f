"""Exact order statistics and positions without sorting everything.

``order_statistics`` answers "which value stands at sorted position r" for
several columns and positions at once. A bounded sketch brackets each wanted
position; one counting pass places the bracket exactly; only rows inside a
bracket are sorted. A bracket is narrowed as long as it holds too many rows, so
the rows of all brackets together, which one task sorts, are at most
``MAX_CANDIDATES`` (a few more only if there are more brackets than that). Give
it a frame that is cheap to scan again (a table, or a materialised stage).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.scalar import dtype, is_numeric
from patronage.session import materialize

MAX_CANDIDATES = 100_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    """Neighbouring positions of one column and the value range that holds them."""

    column: str
    ranks: list[int]
    inside: int
    low: object = None
    high: object = None
    below: int = 0

    def holds(self) -> Column:
        c = F.col(self.column)
        if self.low is None:
            return c.isNotNull()
        return (c >= F.lit(self.low)) & (c <= F.lit(self.high))

    @property
    def span(self) -> tuple:
        return self.column, self.low, self.high, self.below


def scalars(df: DataFrame, **aggs: Column) -> dict:
    """One row of aggregates as Python values (a fixed, tiny result)."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()]).first().asDict()


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    counts: dict[str, int] | None = None,
    max_candidates: int = MAX_CANDIDATES,
) -> dict[str, dict[int, object]]:
    """Value at each 0-based sorted position of each column, nulls left out."""
    if counts is None:
        counts = scalars(df, **{c: F.count(c) for c in ranks})
    found: dict[str, dict[int, object]] = {c: {} for c in ranks}
    small: list[_Bracket] = []
    large: list[_Bracket] = []
    for column, wanted in ranks.items():
        for group in _neighbours(sorted(set(wanted))):
            if not 0 <= group[0] <= group[-1] < counts[column]:
                raise IndexError(f"positions {group} outside the {counts[column]} values of {column}")
            large.append(_Bracket(column, group, counts[column]))
    # All brackets are gathered together; those of one range share its values.
    share = max(1, max_candidates // max(1, len(large)))
    whole = max(1, max_candidates // max(1, len(ranks)))
    while large:
        still = []
        for b in large:
            if b.low is not None and b.low == b.high:
                found[b.column].update(dict.fromkeys(b.ranks, b.low))
            elif b.inside <= (whole if b.low is None else share):
                small.append(b)
            else:
                still.append(b)
        large = _narrow(df, still) if still else []
    _sort_small(df, small, found)
    return found


def _neighbours(ranks: list[int]) -> list[list[int]]:
    """Runs of adjacent positions: an interpolated quantile asks for two of them."""
    groups: list[list[int]] = []
    for r in ranks:
        if groups and r - groups[-1][-1] <= 1:
            groups[-1].append(r)
        else:
            groups.append([r])
    return groups


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Shrink every bracket around its positions: one sketch pass, one counting pass.

    Brackets over the same range share one sketch.
    """
    margin = 2.0 / SKETCH_ACCURACY
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault(b.span, []).append(b)
    groups = list(shared.values())
    asked = [
        [
            min(1.0, max(0.0, (rank - b.below + 0.5) / b.inside + shift))
            for b in g
            for rank, shift in ((b.ranks[0], -margin), (b.ranks[-1], margin))
        ]
        for g in groups
    ]
    aggs = {}
    for i, (g, probs) in enumerate(zip(groups, asked)):
        inner = F.when(g[0].holds(), F.col(g[0].column))
        aggs[f"q{i}"] = F.percentile_approx(inner, probs, SKETCH_ACCURACY)
        aggs[f"lo{i}"], aggs[f"hi{i}"] = F.min(inner), F.max(inner)
    marks = scalars(df, **aggs)

    tallies, proposals = {}, []
    for i, g in enumerate(groups):
        least, most = marks[f"lo{i}"], marks[f"hi{i}"]
        for k, b in enumerate(g):
            # Wide integers pass through the sketch as doubles: clamp to the parent range.
            lo, hi = (min(max(marks[f"q{i}"][2 * k + side], least), most) for side in (0, 1))
            c, j = F.col(b.column), len(proposals)
            tallies[f"below{j}"] = F.count_if(c < F.lit(lo))
            tallies[f"inside{j}"] = F.count_if((c >= F.lit(lo)) & (c <= F.lit(hi)))
            proposals.append((b, lo, hi, least, most))
    n = scalars(df, **tallies)

    out: list[_Bracket] = []
    for j, (b, lo, hi, least, most) in enumerate(proposals):
        below, inside = n[f"below{j}"], n[f"inside{j}"]
        # Positions the proposed range missed keep the part of the parent beside it.
        under = [r for r in b.ranks if r < below]
        within = [r for r in b.ranks if below <= r < below + inside]
        over = [r for r in b.ranks if r >= below + inside]
        if within and inside < b.inside:
            out.append(_Bracket(b.column, within, inside, lo, hi, below))
        elif within:
            out.extend(_peel(df, _Bracket(b.column, within, inside, lo, hi, below)))
        if under:
            out.append(_Bracket(b.column, under, below - b.below + _equal(df, b.column, lo), least, lo, b.below))
        if over:
            ties = _equal(df, b.column, hi)
            start = below + inside - ties
            out.append(_Bracket(b.column, over, b.below + b.inside - start, hi, most, start))
    return out


def _equal(df: DataFrame, column: str, value) -> int:
    return scalars(df, n=F.count_if(F.col(column) == F.lit(value)))["n"]


def _peel(df: DataFrame, b: _Bracket) -> list[_Bracket]:
    """Take the smallest and largest value off a bracket the sketch could not shrink."""
    if b.low == b.high:
        return [b]
    c = F.col(b.column)
    s = scalars(
        df.where(b.holds()),
        at_low=F.count_if(c == F.lit(b.low)),
        at_high=F.count_if(c == F.lit(b.high)),
        second=F.min(F.when(c > F.lit(b.low), c)),
        last_but_one=F.max(F.when(c < F.lit(b.high), c)),
    )
    first, last = b.below + s["at_low"], b.below + b.inside - s["at_high"]
    parts = [
        ([r for r in b.ranks if r < first], s["at_low"], b.low, b.low, b.below),
        ([r for r in b.ranks if first <= r < last], last - first, s["second"], s["last_but_one"], first),
        ([r for r in b.ranks if r >= last], s["at_high"], b.high, b.high, last),
    ]
    return [_Bracket(b.column, *part) for part in parts if part[0]]


def _sort_small(df: DataFrame, brackets: list[_Bracket], found: dict) -> None:
    """Sort the bounded candidates of every bracket in one aggregation."""
    if not brackets:
        return
    # Positions that share a bracket share its candidates.
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault(b.span, []).append(b)
    groups = list(shared.values())
    rows = df
    if all(g[0].low is not None for g in groups):
        rows = df.where(reduce(lambda x, y: x | y, [g[0].holds() for g in groups]))
    sorted_values = rows.agg(
        *[
            F.sort_array(F.collect_list(F.when(g[0].holds(), F.col(g[0].column)))).alias(f"a{i}")
            for i, g in enumerate(groups)
        ]
    )
    picks = [(i, b, r) for i, g in enumerate(groups) for b in g for r in b.ranks]
    row = sorted_values.select(*[F.get(f"a{i}", F.lit(r - b.below)) for i, b, r in picks]).first()
    for value, (_, b, r) in zip(row, picks):
        found[b.column][r] = value


def quantiles(
    df: DataFrame, probs: dict[str, list[float]], max_candidates: int = MAX_CANDIDATES
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles per column; all None for an empty column."""
    counts = scalars(df, **{c: F.count(c) for c in probs})
    ranks: dict[str, list[int]] = {}
    for c, ps in probs.items():
        if counts[c]:
            top = counts[c] - 1
            spots = [top * p for p in ps]
            ranks[c] = [min(math.floor(s), top) for s in spots] + [min(math.floor(s) + 1, top) for s in spots]
    values = order_statistics(df, ranks, counts, max_candidates) if ranks else {}
    out: dict[str, list[float | None]] = {}
    for c, ps in probs.items():
        if not counts[c]:
            out[c] = [None] * len(ps)
            continue
        top = counts[c] - 1
        row = []
        for p in ps:
            spot = top * p
            i = min(math.floor(spot), top)
            a, b = float(values[c][i]), float(values[c][min(i + 1, top)])
            row.append(a + (b - a) * (spot - i))
        out[c] = row
    return out


def extreme_rows(df: DataFrame, by: str, key: str, k: int, largest: bool = True) -> Column:
    """Predicate that holds for exactly the ``k`` extreme rows of ``by``.

    Ties go to the smaller ``key``, a unique number. The rows are found by two
    thresholds, so nothing is sorted and ``k`` may be a share of the table.
    """
    n = scalars(df, n=F.count(by))["n"]
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.col(by).isNotNull()
    rank = n - k if largest else k - 1
    edge = order_statistics(df, {by: [rank]}, {by: n})[by][rank]
    c = F.col(by)
    beyond = c > F.lit(edge) if largest else c < F.lit(edge)
    tally = scalars(df, beyond=F.count_if(beyond), ties=F.count_if(c == F.lit(edge)))
    need = k - tally["beyond"]
    if need == tally["ties"]:
        return beyond | (c == F.lit(edge))
    tied = df.where(c == F.lit(edge))
    last = order_statistics(tied, {key: [need - 1]}, {key: tally["ties"]})[key][need - 1]
    return beyond | ((c == F.lit(edge)) & (F.col(key) <= F.lit(last)))


def with_row_index(df: DataFrame, order_by: list, name: str = "row_index", start: int = 0) -> DataFrame:
    """Consecutive numbers along ``order_by``, computed range by range.

    Rows are range-partitioned and sorted, written once, and numbered as
    "rows in earlier ranges + place in own range"; the offsets are one row per
    range. No step brings all rows to one task.
    """
    ranged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stage = materialize(ranged, "row-index")
    sizes = stage.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        stage.join(F.broadcast(offsets), "_range")  # at most one row per shuffle partition
        .withColumn(name, F.col("_offset") + F.col("_place") + F.lit(start))
        .drop("_range", "_place", "_offset", "_n")
    )


def running_total(df: DataFrame, order_by: str, values: list[str]) -> DataFrame:
    """Add ``<v>_before``: the sum of each value over rows of smaller ``order_by``.

    ``order_by`` is unique in ``df``. Same range scheme as ``with_row_index``.
    """
    stage = materialize(
        df.repartitionByRange(order_by).withColumn("_range", F.spark_partition_id()), "running-total"
    )
    sums = stage.groupBy("_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}_off") for v in values]
    )
    local = Window.partitionBy("_range").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = stage.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_{v}_in") for v in values])
    out = placed.join(F.broadcast(offsets), "_range")
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"_{v}_off") + F.col(f"_{v}_in"))
    return out.select(*df.columns, *[f"{v}_before" for v in values])


def unique_number(df: DataFrame, key: str, name: str = "_key_no") -> tuple[DataFrame, str]:
    """A numeric stand-in for ``key`` in the same order (the key itself if numeric)."""
    if is_numeric(dtype(df, key)):
        return df, key
    return with_row_index(df, [F.col(key)], name), name
