"""Forests whose trees are grown in tasks, a few trees each, and scored where the rows are.

A level of a tree is cheap, but a forest of deep trees has millions of nodes: found
node by node over the cluster, with every node known to the driver, they take
hours. Here all rows to fit go to every task that grows some of the trees, as small
as they can be: a row is its label and the bin of each feature, ten to twenty bytes.
Rows that agree in every bin share a cell, which no split divides, so a tree is
grown over cells, a bounded number of them at a time, with array operations. Trees
are rows of a table in the shared folder; neither they nor the rows reach the driver.

Trees follow the usual rules: Poisson bootstrap, thresholds at up to ``maxBins``
quantiles, a random part of the features per node in a classification, variance as
impurity (of two classes 0 and 1 it is half the Gini impurity, so the splits are the same).
Nothing depends on partitions: rows are put in the order of their key's hash.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.operators.joins import join_one
from patronage.session import materialize, scratch_path

CHUNK = 25  # trees judged or scored by one task, at most
GROWN = 5  # trees grown by one task
GROUP = 1_000_000  # cells scored by one task
NODES = 2_000_000  # nodes of the trees by which one task scores; a larger tree has a task of its own
BLOCK = 1 << 16  # cells whose nodes are split together
ROWS = 1 << 19  # rows drawn and summed together
ARRAYS = {"feature": "int", "threshold": "double", "child": "int", "rows": "long", "value": "double", "gain": "double"}
WALKED = ["feature", "threshold", "child", "rows", "value"]  # what a walk reads
TREES = "treeID int, importance array<double>, " + ", ".join(f"{c} array<{t}>" for c, t in ARRAYS.items())


# --- growing one tree ---------------------------------------------------------------


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between neighbouring values: all of them, or at equal shares of the rows."""
    values, counts = np.unique(x, return_counts=True)
    middle = values[:-1] + (values[1:] - values[:-1]) / 2
    if len(values) <= bins:
        return middle
    at = np.searchsorted(np.cumsum(counts), len(x) * np.arange(1, bins) / bins)
    return middle[np.unique(np.clip(at, 0, len(middle) - 1))]


def grow_tree(bins: np.ndarray, cuts: list, y: np.ndarray, draw: np.ndarray, depth: int, leaf: int, least: int, tried: int, rng) -> dict:
    """One tree of rows that are drawn ``draw`` times. Children stand side by side: ``child`` and ``child + 1``, or -1 in a leaf."""
    used = np.flatnonzero(draw)
    y, w = y[used], draw[used].astype(float)
    return _grow(_Cells(bins[:, used], w, w * y, y, y), cuts, depth, leaf, least, tried, rng)


@dataclass
class _Cells:
    """Rows that agree in all bins: their weight, weighted sum, least and greatest label. A single row may be a cell."""

    bins: np.ndarray
    w: np.ndarray
    wy: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def at(self, index: np.ndarray) -> _Cells:
        return _Cells(self.bins[:, index], self.w[index], self.wy[index], self.low[index], self.high[index])


def _grow(cells: _Cells, cuts: list, depth: int, leaf: int, least: int, tried: int, rng) -> dict:
    """Nodes of many cells are split one by one; smaller ones together, up to ``BLOCK`` cells at a time."""
    d = len(cells.bins)
    out = {c: [] for c in ARRAYS}  # a piece per group of nodes: the nodes that follow those already known
    importance, known = np.zeros(d), 1
    large, small = [(0, 0, np.arange(len(cells.w)))], []  # (number, level, cells) of nodes still to be split
    given: dict[int, tuple] = {}  # what is found of nodes that were numbered by their parents
    while large:
        number, level, index = large.pop()
        if len(index) <= BLOCK:
            small.append((number, level, index))
            continue
        node, bin_ = _split_one(cells, index, cuts, level < depth, leaf, least, tried, rng)
        if node["feature"] >= 0:
            importance[node["feature"]] += node["gain"] * node["rows"]
            right = cells.bins[node["feature"], index] > bin_
            node["child"], known = known, known + 2
            large += [(node["child"] + 1, level + 1, index[right]), (node["child"], level + 1, index[~right])]
        given[number] = tuple(node[c] for c in ARRAYS)
    top = known
    while small:
        group, total = [], 0
        while small and (not group or total + len(small[0][2]) <= BLOCK):
            group.append(small.pop(0))
            total += len(group[-1][2])
        levels, sizes = (np.array(v) for v in zip(*[(level, len(index)) for _, level, index in group]))
        found, gains = _split_all(cells.at(np.concatenate([index for _, _, index in group])), sizes, levels, cuts, depth, leaf, least, tried, rng)
        importance += gains
        m = len(group)  # the first nodes found are those of the group, which have their numbers; the others follow
        found["child"] = np.where(found["child"] >= 0, found["child"] + known - m, -1)
        for i, (number, _, _) in enumerate(group):
            given[number] = tuple(found[c][i] for c in ARRAYS)
        for c, kind in ARRAYS.items():
            out[c].append(found[c][m:].astype(np.int32 if kind == "int" else float))
        known += len(found["child"]) - m
    tree = {}
    for c, column in zip(ARRAYS, zip(*[given[i] for i in range(top)])):
        tree[c] = np.concatenate([np.array(column, np.int32 if ARRAYS[c] == "int" else float), *out.pop(c)])
    return tree | {"importance": importance / importance.sum() if importance.sum() > 0 else importance}


def _split_one(cells: _Cells, index: np.ndarray, cuts: list, open_: bool, leaf: int, least: int, tried: int, rng) -> tuple[dict, int]:
    """A node of many cells and the last bin on the left of its best split, from sums by bin."""
    d, w, wy = len(cells.bins), cells.w[index], cells.wy[index]
    weight, total = w.sum(), wy.sum()
    base = total * total / weight
    best, feature, bin_ = -np.inf, -1, 0
    if open_ and weight >= max(least, 2) and cells.high[index].max() > cells.low[index].min():
        for f in np.flatnonzero(rng.random((d, 1)).argsort(axis=0).argsort(axis=0)[:, 0] < tried) if tried < d else range(d):
            b = cells.bins[f, index]
            left, sum_ = (np.cumsum(np.bincount(b, v))[:-1] for v in (w, wy))
            right = weight - left
            with np.errstate(divide="ignore", invalid="ignore"):
                score = sum_ * sum_ / left + (total - sum_) ** 2 / right
            score[(left < max(leaf, 1)) | (right < max(leaf, 1))] = -np.inf
            if len(score) and score.max() > best:
                best, feature, bin_ = score.max(), int(f), int(score.argmax())
    gain = best - base if np.isfinite(best) else 0.0
    splits = gain > 1e-12 * abs(base)
    return {
        "feature": feature if splits else -1, "threshold": cuts[feature][bin_] if splits else 0.0, "child": -1, "rows": weight,
        "value": total / weight, "gain": gain / weight if splits else -1.0,
    }, bin_


def _split_all(cells: _Cells, sizes: np.ndarray, levels: np.ndarray, cuts: list, depth: int, leaf: int, least: int, tried: int, rng) -> tuple[dict, np.ndarray]:
    """All that grows from nodes whose cells lie one after the other, level by level.

    Every feature keeps the cells ordered by (node, bin), so a level's candidates are running sums.
    """
    bins, w, wy = cells.bins, cells.w, cells.wy
    d, n = bins.shape
    segment = np.repeat(np.arange(len(sizes)), sizes)
    order = np.stack([np.lexsort((b, segment)) for b in bins]) if len(sizes) > 1 else np.argsort(bins, axis=1, kind="stable")
    out = {c: [] for c in ARRAYS}
    importance, known = np.zeros(d), len(sizes)
    while True:
        k, starts = len(sizes), np.r_[0, np.cumsum(sizes)[:-1]]
        total, weight = np.add.reduceat(wy[order[0]], starts), np.add.reduceat(w[order[0]], starts)
        low, high = np.minimum.reduceat(cells.low[order[0]], starts), np.maximum.reduceat(cells.high[order[0]], starts)
        base = total * total / weight
        best = np.full(k, -np.inf)
        segment = np.repeat(np.arange(k), sizes)
        open_ = (high > low) & (weight >= max(least, 2)) & (levels < depth)
        f = at = ()
        if open_.any():
            b = np.take_along_axis(bins, order, 1)
            ends = np.zeros(b.shape, bool)
            ends[:, :-1] = (b[:, :-1] != b[:, 1:]) & (segment[:-1] == segment[1:])
            ends &= open_[segment]
            if tried < d:
                ends &= (rng.random((d, k)).argsort(axis=0).argsort(axis=0) < tried)[:, segment]
            f, at = np.nonzero(ends)
        if len(f):
            sw, sy = np.cumsum(w[order], 1), np.cumsum(wy[order], 1)
            seg, zero = segment[at], starts[segment[at]]
            left, sum_ = sw[f, at], sy[f, at]
            before = zero > 0
            left = left - np.where(before, sw[f, zero - 1], 0.0)
            sum_ = sum_ - np.where(before, sy[f, zero - 1], 0.0)
            right = weight[seg] - left
            score = sum_ * sum_ / left + (total[seg] - sum_) ** 2 / right
            score[(left < leaf) | (right < leaf)] = -np.inf
            np.maximum.at(best, seg, score)
        gain = np.where(np.isfinite(best), best - base, 0.0)
        splits = gain > 1e-12 * np.abs(base)
        feature, bin_, threshold = np.full(k, -1), np.zeros(k, int), np.zeros(k)
        if splits.any():
            hit = np.flatnonzero((score == best[seg]) & splits[seg])[::-1]  # the first of equal splits is written last
            feature[seg[hit]], bin_[seg[hit]] = f[hit], b[f[hit], at[hit]]
            # The threshold is the first beyond the last bin on the left.
            threshold[splits] = [cuts[i][j] for i, j in zip(feature[splits], bin_[splits])]
            importance += np.bincount(feature[splits], gain[splits], d)
        child = np.where(splits, known + 2 * (np.cumsum(splits) - 1), -1)
        known += 2 * int(splits.sum())
        for name, values in zip(ARRAYS, (feature, threshold, child, weight, total / weight, np.where(splits, gain / weight, -1.0))):
            out[name].append(values)
        if not splits.any():
            break
        # Cells move, in their order, to the left or the right child; those of leaves are done.
        owner = np.full(n, -1)
        owner[order[0]] = segment
        place = np.cumsum(splits) - 1
        stays = splits[owner] & (owner >= 0)
        goes_right = bins[feature[owner], np.arange(n)] > bin_[owner]
        new = np.where(stays, 2 * place[owner] + goes_right, -1)
        sizes = np.bincount(new[stays], minlength=2 * int(splits.sum()))
        levels = np.repeat(levels[splits] + 1, 2)
        offset, kept = np.r_[0, np.cumsum(sizes)[:-1]], []
        for o in order:
            o = o[stays[o]]
            side = goes_right[o]
            # Place among the cells of the same child: running counts, less those before the parent's first cell.
            parent = place[owner[o]]
            first = offset[2 * parent]
            rights, span = np.cumsum(side) - side, np.arange(len(o))
            begun = np.r_[rights, rights[-1] + side[-1]][first]
            inside = np.where(side, rights - begun, (span - first) - (rights - begun))
            moved = np.empty_like(o)
            moved[offset[2 * parent + side] + inside] = o
            kept.append(moved)
        order = np.stack(kept)
    return {c: np.concatenate(v) for c, v in out.items()}, importance


def cells_of(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their cells, those of a cell in their old order, and the first place of each cell."""
    key, width = np.zeros(bins.shape[1], np.int64), 1
    for b in bins:
        size = int(b.max(initial=0)) + 1
        if width * size >= 1 << 62:  # numbers in place of the bins so far
            key = np.unique(key, return_inverse=True)[1]
            width = int(key.max(initial=0)) + 1
        key, width = key * size + b, width * size
    order = np.argsort(key, kind="stable")
    key = key[order]
    order = order.astype(np.int32) if len(order) < 1 << 31 else order
    return order, np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def walk(tree: dict, x: np.ndarray, depths: list[int], least: int = 2) -> list[np.ndarray]:
    """Value of each row's node after at most so many steps, for each of ``depths``; smaller nodes than ``least`` are not left."""
    node, rows, found = np.zeros(x.shape[1], int), np.arange(x.shape[1]), {}
    stop = (tree["child"] < 0) | (tree["rows"] < least)
    for step in range(max(depths) + 1):
        if step in depths:
            found[step] = tree["value"][node]
        rows = rows[~stop[node[rows]]]
        if not len(rows):
            break
        at = node[rows]
        node[rows] = tree["child"][at] + (x[tree["feature"][at], rows] > tree["threshold"][at])
    return [found[d] if d in found else tree["value"][node] for d in depths]


# --- rows and trees as tables ---------------------------------------------------------


def _lists(values: list[np.ndarray], kind: str) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0)
    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype({"byte": "i1", "short": "i2", "int": "i4", "double": "f8", "long": "i8"}[kind])))


def _column(table: pa.Table, name: str) -> np.ndarray:
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table.column(name).chunks]
    return np.concatenate(parts) if parts else np.zeros(0)


def _lifted(bins: int) -> tuple[str, type]:
    """The smallest type of Spark and numpy for so many bins."""
    return ("tinyint", np.int8) if bins <= 128 else ("smallint", np.int16)


def find_cuts(rows: DataFrame, width: int, bins: int, folds: int) -> list[list[np.ndarray]]:
    """Thresholds of each feature (``cut_points``), over all rows or, for each fold, over the rows outside it.

    A task takes one feature of all rows; only the thresholds reach the driver.
    """
    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width, dtype=np.int32)), _lists(list(x.T), "double"), _lists([fold] * width, "byte")], ["job", "v", "fold"]
                )

    def cut(table: pa.Table) -> pa.Table:
        v, fold, at = _column(table, "v"), _column(table, "fold"), table.column("job")[0].as_py()
        found = [cut_points(v[fold != k], bins) for k in range(folds)] if folds else [cut_points(v, bins)]
        return pa.table({"at": pa.array([at] * len(found), pa.int32()), "k": pa.array(range(len(found)), pa.int32()), "cuts": _lists(found, "double")})

    stacked = rows.select("x", "fold").mapInArrow(columns, "job int, v array<double>, fold array<tinyint>")
    dealt = stacked.repartitionById(width, "job").groupBy("job")
    out = [[np.zeros(0)] * width for _ in range(max(folds, 1))]
    for r in dealt.applyInArrow(cut, "at int, k int, cuts array<double>").collect():  # under ``bins`` numbers a feature and fold
        out[r.k][r.at] = np.array(r.cuts, float)
    return out


@dataclass
class FitRows:
    """The rows to fit as blocks along their keys' hashes, with the bins of every row by each set of thresholds."""

    blocks: DataFrame
    cuts: list[list[np.ndarray]]

    @staticmethod
    def of(df: DataFrame, estimator, key: str, folds: int = 0) -> FitRows:
        """With ``folds``, a set of thresholds for each, over the rows outside it; else one over all rows."""
        fold = F.col("_fold").cast("tinyint") if folds else F.lit(0).cast("tinyint")
        x = vector_to_array(estimator.getFeaturesCol())
        rows = df.select(F.xxhash64(key).alias("place"), F.col(estimator.getLabelCol()).cast("double").alias("y"), fold.alias("fold"), x.alias("x"))
        rows = materialize(rows, "rows-to-fit")
        first, bins = rows.select(F.size("x").alias("n")).first(), estimator.getMaxBins()
        width = first.n if first else 0
        cuts = find_cuts(rows, width, bins, folds)
        sets, (kind, lifted) = range(len(cuts)), _lifted(bins)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for number, batch in enumerate(batches):
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                given = {"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32())}
                given |= {c: _lists([batch.column(c).to_numpy(zero_copy_only=False)], k) for c, k in (("y", "double"), ("fold", "byte"))}
                for k in sets:
                    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts[k], x.T)]).astype(lifted)
                    given[f"b{k}"] = _lists([binned.ravel()], "byte" if lifted is np.int8 else "short")
                yield pa.RecordBatch.from_pydict(given)

        shape = "part int, number int, y array<double>, fold array<tinyint>, " + ", ".join(f"b{k} array<{kind}>" for k in sets)
        along = rows.repartitionByRange("place").sortWithinPartitions("place", "y").mapInArrow(pack, shape)
        return FitRows(materialize(along, "fit-rows"), cuts)

    def dealt(self, sets: list[int]):
        """Every block to every job, a job to a task of its own; a job takes the bins by the set of thresholds stated for it."""
        jobs = F.explode(F.array(*[F.struct(F.lit(j).alias("job"), F.lit(k).alias("k")) for j, k in enumerate(sets)])).alias("job")
        bins = F.coalesce(*[F.when(F.col("job.k") == k, F.col(f"b{k}")) for k in range(len(self.cuts))]).alias("bins")
        dealt = self.blocks.select("*", jobs).select("job.job", "part", "number", "y", "fold", bins)
        return dealt.repartitionById(len(sets), "job").groupBy("job")


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The job's number, bins by feature, labels and folds of all rows, in the order of the keys' hashes."""
    found, job = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            job = batch.column("job")[i].as_py()
            y, fold, bins = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("y", "fold", "bins"))
            found.append((batch.column("part")[i].as_py(), batch.column("number")[i].as_py(), y, fold, bins.reshape(-1, len(y))))
    found.sort(key=lambda block: block[:2], reverse=True)
    n, (_, _, y, fold, bins) = sum(len(block[2]) for block in found), found[0]
    out = np.empty((len(bins), n), bins.dtype), np.empty(n, y.dtype), np.empty(n, fold.dtype)
    at = 0
    while found:  # a block is let go when it is copied
        _, _, y, fold, bins = found.pop()
        for whole, part in zip(out, (bins, y, fold)):
            whole[..., at : at + len(y)] = part
        at += len(y)
    return job, *out


def _drawn(bins: np.ndarray, y: np.ndarray, draw: np.ndarray, starts: np.ndarray) -> _Cells:
    """The cells of which a row is drawn, summed some rows at a time."""
    sums = [np.empty(len(starts)) for _ in range(4)]
    edges = np.r_[np.unique(np.searchsorted(starts, np.arange(0, len(y), ROWS))), len(starts)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            rows = slice(starts[a], starts[b] if b < len(starts) else len(y))
            w, v, at = draw[rows], y[rows], starts[a:b] - starts[a]
            sums[0][a:b], sums[1][a:b] = np.add.reduceat(w.astype(float), at), np.add.reduceat(w * v, at)
            sums[2][a:b] = np.minimum.reduceat(np.where(w > 0, v, np.inf), at)
            sums[3][a:b] = np.maximum.reduceat(np.where(w > 0, v, -np.inf), at)
    used = np.flatnonzero(sums[0])
    return _Cells(bins[:, used], *[v[used] for v in sums])


@dataclass
class Rules:
    """What the trees of a forest have in common."""

    seed: int
    bins: int
    classes: bool
    depth: int
    leaf: int
    least: int = 2

    @staticmethod
    def of(estimator, depth: int | None = None, leaf: int | None = None, least: int = 2) -> Rules:
        return Rules(
            estimator.getSeed(), estimator.getMaxBins(), isinstance(estimator, RandomForestClassifier),
            depth or estimator.getMaxDepth(), leaf or estimator.getMinInstancesPerNode(), least,
        )

    def trees(self, bins: np.ndarray, cuts: list, y: np.ndarray, numbers: range) -> Iterator[dict]:
        """Trees by number; a tree is the same whichever task grows it."""
        tried = math.ceil(math.sqrt(len(bins))) if self.classes else len(bins)
        middle = 0.0 if self.classes else y.mean()  # sums stay small, and whole numbers stay whole
        order, starts = cells_of(bins)
        bins, y = np.ascontiguousarray(bins[:, order[starts]]), y[order] - middle
        for number in numbers:
            rng = np.random.default_rng([self.seed, number])
            draw = np.empty(len(y), np.int16)
            for at in range(0, len(y), ROWS):  # the same numbers as drawn at once
                draw[at : at + ROWS] = rng.poisson(1.0, len(draw[at : at + ROWS]))
            if not draw.any():
                draw[:] = 1
            cells = _drawn(bins, y, draw[order], starts)
            del draw
            tree = _grow(cells, cuts, self.depth, self.leaf, self.least, tried, rng)
            tree["value"] += middle
            yield tree
            del tree


def _chunks(marks: list[int], most: int = CHUNK) -> list[range]:
    """Numbers of trees in chunks that end at each of ``marks``."""
    edges = [0, *sorted(set(marks))]
    return [range(a, min(a + most, end)) for start, end in zip(edges, edges[1:]) for a in range(start, end, most)]


def _corners(cuts: list, bins: np.ndarray) -> np.ndarray:
    """The greatest values in the given bins, which meet every threshold as any value of the bin does."""
    return np.stack([np.append(c, np.inf)[b] for c, b in zip(cuts, bins)])


def importances(df: DataFrame, estimator, key: str) -> np.ndarray:
    """Share of each feature in the impurity that a forest takes away."""
    rules, chunks = Rules.of(estimator), _chunks([estimator.getNumTrees()], GROWN)
    fit = FitRows.of(df, estimator, key)
    cuts = fit.cuts[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, bins, y, _ = _gathered(batches)
        trees = rules.trees(bins, cuts, y, chunks[job])
        del bins, y
        shares = [next(trees)["importance"] for _ in chunks[job]]
        yield pa.RecordBatch.from_pydict({"treeID": pa.array(list(chunks[job]), pa.int32()), "importance": _lists(shares, "double")})

    found = fit.dealt([0] * len(chunks)).applyInArrow(measure, "treeID int, importance array<double>").collect()  # a few numbers a tree
    mean = np.sum([r.importance for r in sorted(found, key=lambda r: r.treeID)], axis=0)
    return mean / mean.sum() if mean.sum() > 0 else mean


def _sliced(columns: dict[str, pa.Array], n: int, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_pydict(columns)
    for start in range(0, max(n, 1), rows):
        yield batch.slice(start, rows)


def fold_scores(df: DataFrame, estimator, key: str, folds: int, settings: dict[str, list]) -> DataFrame:
    """Held-out values of a whole grid: a row per fit row and ``leaf``, a column per number of trees, depth and split size.

    A forest of the most trees and the greatest depth holds the others of its leaf
    size: its first trees, and its trees as far as the smaller depth or the split size
    lets them go. Columns are named by ``score_name``; ``fold`` is the one held out.
    Held-out cells are scored; their rows meet the scores at the end.
    """
    leaves, sizes, depths = settings["minInstancesPerNode"], settings["minSplit"], sorted(settings["maxDepth"])
    chunks = _chunks(settings["numTrees"])
    jobs = [(leaf, fold, c) for leaf in leaves for fold in range(folds) for c in range(len(chunks))]
    rules = {leaf: Rules.of(estimator, depths[-1], leaf, min(sizes)) for leaf in leaves}
    cases = [(depth, size) for size in sizes for depth in depths]
    fit = FitRows.of(df, estimator, key, folds)
    cuts = fit.cuts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, bins, y, folded = _gathered(batches)
        leaf, fold, c = jobs[job]
        held, learnt = bins[:, folded == fold], folded != fold
        order, starts = cells_of(held)
        x, n = _corners(cuts[fold], held[:, order[starts]]), len(starts)
        del held, order
        sums = np.zeros((len(cases), n))
        if n and learnt.any():
            trees = rules[leaf].trees(bins[:, learnt], cuts[fold], y[learnt], chunks[c])
            del bins, y, folded, learnt
            for _ in chunks[c]:
                tree = next(trees)
                for i, size in enumerate(sizes):
                    sums[i * len(depths) : (i + 1) * len(depths)] += walk(tree, x, depths, size)
                del tree
        same = {k: pa.array(np.full(n, v, np.int32)) for k, v in (("leaf", leaf), ("fold", fold), ("chunk", c))}
        yield from _sliced(same | {"cell": pa.array(np.arange(n, dtype=np.int32))} | {f"s{i}": pa.array(s) for i, s in enumerate(sums)}, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, bins, y, folded = _gathered(batches)  # a job a fold
        order, starts = cells_of(bins[:, folded == fold])
        n, cell = len(order), np.zeros(len(order), np.int32)
        cell[starts[1:]] = 1
        same = {"fold": pa.array(np.full(n, fold, np.int32)), "cell": pa.array(np.cumsum(cell, dtype=np.int32))}
        yield from _sliced(same | {"y": pa.array(y[folded == fold][order])}, n)

    shape = "leaf int, fold int, chunk int, cell int, " + ", ".join(f"s{i} double" for i in range(len(cases)))
    parts = fit.dealt([fold for _, fold, _ in jobs]).applyInArrow(judge, shape)
    rows = fit.dealt(list(range(folds))).applyInArrow(place, "fold int, cell int, y double")
    # Chunks are added in their order, so the sums do not depend on the shuffle.
    each = [F.max(F.when(F.col("chunk") == c, F.col(f"s{i}"))).alias(f"s{i}_{c}") for i in range(len(cases)) for c in range(len(chunks))]
    per = parts.groupBy("leaf", "fold", "cell").agg(*each)
    columns = []
    for trees in settings["numTrees"]:
        inside = [c for c, numbers in enumerate(chunks) if numbers.stop <= trees]
        for i, (depth, size) in enumerate(cases):
            columns.append((sum((F.col(f"s{i}_{c}") for c in inside), F.lit(0.0)) / trees).alias(score_name(trees, depth, size)))
    scored = materialize(per.select("leaf", "fold", "cell", *columns), "cell-scores")
    return rows.join(scored, ["fold", "cell"]).drop("cell")


def score_name(trees: int, depth: int, size: int) -> str:
    return f"t{trees}_d{depth}_s{size}"


class GrownForest:
    """A forest as a table of trees in a folder; ``transform`` and saving are those of a fitted stage of ``pyspark.ml``."""

    def __init__(self, path: str, about: dict):
        self.path, self.about = path, about

    @property
    def getNumTrees(self) -> int:
        return self.about["numTrees"]

    def trees(self) -> DataFrame:
        return SparkSession.active().read.schema(TREES).parquet(f"{self.path}/data")

    def nodes(self) -> DataFrame:
        """One row per node: ``treeID``, ``id``, its children, split, rows as the bootstrap drew them, and value."""
        zipped = self.trees().select("treeID", F.posexplode(F.arrays_zip(*ARRAYS)).alias("id", "node"))
        left = F.col("node.child")
        return zipped.select(
            "treeID", "id", left.alias("leftChild"), F.when(left >= 0, left + 1).otherwise(-1).alias("rightChild"),
            F.col("node.feature").alias("feature"), F.col("node.threshold").alias("threshold"),
            F.col("node.rows").alias("rawCount"), F.col("node.value").alias("prediction"), F.col("node.gain").alias("gain"),
        )

    def cut_back(self, least: int) -> GrownForest:
        """The forest as if nodes of fewer than ``least`` rows had not been split; what lay below stays in the table, unreached."""
        closed = F.transform(F.arrays_zip("child", "rows"), lambda n: F.when(n["rows"] < least, F.lit(-1)).otherwise(n["child"]))
        path = scratch_path(SparkSession.active(), "cut")
        prune(self.trees().withColumn("child", closed)).write.parquet(f"{path}/data")
        return GrownForest(path, self.about)

    def cuts(self) -> list[np.ndarray]:
        """Thresholds by feature: those that the trees were grown with, or of a forest saved without them, those that its trees hold."""
        if "cuts" in self.about:
            return [np.array(c, float) for c in self.about["cuts"]]
        splits = self.nodes().where("leftChild >= 0").groupBy("feature").agg(F.sort_array(F.collect_set("threshold")).alias("cuts"))
        found = {r.feature: np.array(r.cuts, float) for r in splits.collect()}  # under ``maxBins`` numbers a feature
        return [found.get(i, np.zeros(0)) for i in range(max(found, default=-1) + 1)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``probability`` in a classification.

        Rows of the same bins have the same value, so each cell that occurs is scored once: some of the cells meet some of
        the trees in a task, and the sums are joined back to the rows.
        """
        about, total, cuts, depth = self.about, self.getNumTrees, self.cuts(), self.about["maxDepth"]

        @F.arrow_udf("string")
        def cell(x: pa.Array) -> pa.Array:
            return _named(cuts, x)

        given = materialize(df.withColumn("_cell", cell(vector_to_array(about["features"]))), "to-score")
        cells = materialize(given.select("_cell").distinct(), "cells")
        groups, parts = max(1, math.ceil(cells.count() / GROUP)), self._parts()
        blocks = cells.mapInArrow(_joined, "cells string").withColumn("row_part", F.pmod(F.xxhash64("cells"), F.lit(groups)).cast("int"))
        blocks = blocks.withColumn("tree_part", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1))))
        part_of = F.element_at(F.array(*[F.lit(p) for p, inside in enumerate(parts) for _ in inside]), F.col("treeID") + 1)
        trees = self.trees().select("treeID", *WALKED).withColumn("row_part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        trees = trees.withColumn("tree_part", part_of)

        def score(rows: pa.Table, some: pa.Table) -> pa.Table:
            names = pa.concat_arrays([pc.list_flatten(pc.split_pattern(c, " ")) for c in rows.column("cells").chunks]) if rows.num_rows else pa.array([], pa.string())
            sums = np.zeros(len(names))
            if len(names):
                x = _corners(cuts, _numbered(names, len(cuts)))
                for tree in sorted(_unpacked(some, WALKED), key=lambda t: t["treeID"]):
                    sums += walk(tree, x, [depth])[0]
            part = rows.column("tree_part")[0].as_py() if len(names) else 0
            return pa.table({"cell": names, "part": pa.array(np.full(len(names), part, np.int32)), "s": sums})

        keys = ["tree_part", "row_part"]
        found = blocks.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(score, "cell string, part int, s double")
        mean = found.groupBy("cell").agg(*[F.max(F.when(F.col("part") == i, F.col("s"))).alias(f"s{i}") for i in range(len(parts))])
        mean = mean.select(F.col("cell").alias("_cell"), (sum((F.col(f"s{i}") for i in range(1, len(parts))), F.col("s0")) / total).alias("_value"))
        out = join_one(given, materialize(mean, "values"), "_cell", "left").drop("_cell").select(*df.columns, "_value")
        if not about["classes"]:
            return out.withColumnRenamed("_value", "prediction")
        p = F.col("_value")
        return out.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")}).drop("_value")

    def _parts(self) -> list[range]:
        """Numbers of trees in parts of about ``NODES`` nodes and at most ``CHUNK`` trees."""
        sizes = dict(self.trees().select("treeID", F.size("child")).collect())  # a number a tree
        parts, start, held = [], 0, 0
        for number in range(self.getNumTrees):
            if number > start and (held + sizes[number] > NODES or number - start == CHUNK):
                parts.append(range(start, number))
                start, held = number, 0
            held += sizes[number]
        return [*parts, range(start, self.getNumTrees)]

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @staticmethod
    def load(path: str) -> GrownForest:
        return GrownForest(path, json.loads(SparkSession.active().read.text(f"{path}/metadata").first()["value"]))


class ForestWriter(MLWriter):
    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        self.forest.trees().write.parquet(f"{path}/data")
        self.sparkSession.createDataFrame([(json.dumps(self.forest.about),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def _named(cuts: list, x: pa.Array) -> pa.Array:
    """Two characters a feature that name its bin: rows of the same bins have the same name."""
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    bins = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values.T)], 1) if cuts else np.zeros((len(x), 0), int)
    text = np.ascontiguousarray((48 + np.stack([bins // 64, bins % 64], 2)).astype(np.uint8).reshape(len(x), -1))
    ends = (np.arange(len(x) + 1) * text.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(text.tobytes())])


def _numbered(names: pa.Array, width: int) -> np.ndarray:
    """Bins by feature of cells named by ``_named``."""
    text = np.frombuffer("".join(names.to_pylist()).encode(), np.uint8).reshape(len(names), width, 2).astype(int) - 48
    return (text[:, :, 0] * 64 + text[:, :, 1]).T


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of names as one text."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"cells": pa.array([" ".join(batch.column(0).to_pylist())])})


def _unpacked(table: pa.Table, columns: list[str]) -> Iterator[dict]:
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in columns} | {"treeID": batch.column("treeID")[i].as_py()}


def _tree_batch(numbers: list[int], trees: list[dict]) -> pa.RecordBatch:
    columns = {"treeID": pa.array(numbers, pa.int32()), "importance": _lists([t["importance"] for t in trees], "double")}
    columns |= {c: _lists([t[c] for t in trees], kind) for c, kind in ARRAYS.items()}
    return pa.RecordBatch.from_pydict(columns)


def prune(trees: DataFrame) -> DataFrame:
    """Trees without the nodes that no walk reaches any more; numbers are consecutive again, in their old order."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in [*ARRAYS, "importance"]}
                inner, reached = np.flatnonzero(tree["child"] >= 0), np.zeros(len(tree["child"]), bool)
                level = np.array([0])
                while len(level):
                    reached[level] = True
                    level = tree["child"][level]
                    level = level[level >= 0]
                    level = np.r_[level, level + 1]
                new, leaf = np.cumsum(reached) - 1, np.ones(len(reached), bool)
                leaf[inner] = False
                child = np.where(leaf, -1, new[tree["child"]])
                out = {c: tree[c][reached] for c in ARRAYS} | {"importance": tree["importance"], "child": child[reached]}
                for c, closed in (("feature", -1), ("threshold", 0.0), ("gain", -1.0)):
                    out[c] = np.where(leaf[reached], closed, out[c])
                yield _tree_batch([batch.column("treeID")[i].as_py()], [out])

    return trees.select("treeID", "importance", *ARRAYS).mapInArrow(clean, TREES)


def grow_forest(df: DataFrame, estimator, key: str, least: int = 2) -> GrownForest:
    """The forest that ``estimator`` (a random forest of ``pyspark.ml``) describes; nodes of fewer than ``least`` rows are not split."""
    spark, rules, chunks = df.sparkSession, Rules.of(estimator, least=least), _chunks([estimator.getNumTrees()], GROWN)
    fit = FitRows.of(df, estimator, key)
    cuts = fit.cuts[0]
    about = {
        "features": estimator.getFeaturesCol(), "numTrees": estimator.getNumTrees(), "classes": rules.classes, "maxDepth": rules.depth,
        "cuts": [c.tolist() for c in cuts],
    }

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, bins, y, _ = _gathered(batches)
        trees = rules.trees(bins, cuts, y, chunks[job])
        del bins, y
        for number in chunks[job]:
            yield _tree_batch([number], [next(trees)])

    path = scratch_path(spark, "grown")
    fit.dealt([0] * len(chunks)).applyInArrow(plant, TREES).write.parquet(f"{path}/data")
    return GrownForest(path, about)
