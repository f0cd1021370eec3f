"""Near copies among embeddings: a forest of random-projection trees with spill.

Each tree splits the vectors again and again along random directions at random
quantiles near the middle; vectors near a split go to both sides. Vectors meet
in the leaves of all trees, where the cosine of every pair is taken in double
precision. A pair that meets in several leaves counts in the first only, so
link counts leave the leaves, and a spanning forest, but never the pairs.

A leaf larger than a block is compared block by block. A part of the corpus so
dense that no split divides it is taken out beforehand: around a centre,
vectors within half the linking angle are all linked with each other, so their
links are counted, not compared; they meet only those outside that a link can
reach.

The number of trees is measured on the fitted rows, not derived: trees are
added until enough of the linked pairs among them, and of pairs planted just at
the limit, have met. A loose group, which is no dense part, asks for more; if
it asks for too many, leaves get larger, in the end one leaf with all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from patronage.llm.common import components, total
from patronage.session import materialize

COSINE, RECALL = 0.9, 0.999
#: Rows that fit splits and centres (in expectation), rows of a leaf, and of a block of a larger leaf.
FIT_ROWS, LEAF_ROWS, BLOCK_ROWS = 16_384, 1024, 2048
#: A centre needs this share of the first CENTRE_ROWS of the fitted rows near it.
CENTRE_ROWS, CENTRE_SHARE = 4096, 0.008
#: Half the spill, in standard deviations of the distance that a split sees between two linked vectors.
SPILL = 0.25
#: With more trees than this, all are made with one split less from top to bottom.
MOST_TREES = 64
#: Pairs of each kind that trees are measured on, and fitted rows compared with all others at once to find them.
PAIRS, PAIR_ROWS = 8192, 512


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """Trees and dense centres, fitted on unit vectors; ``rows`` is the number to be divided."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float, seed: int = 23):
        self.angle = math.acos(cosine)
        self.centres = self._centres(sample[:CENTRE_ROWS])
        sample = sample[self.ball(sample) < 0]
        d = sample.shape[1]
        sigma = math.sqrt(2 - 2 * cosine) / math.sqrt(d)
        self.spill = SPILL * sigma
        levels = max(0, min(math.ceil(math.log2(max(rows, 1) / LEAF_ROWS)), int(math.log2(max(1, len(sample) / 8)))))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.trees, pairs = [], self._pairs(sample, rng) if levels else None
        while not self.trees:
            self.trees = self._grow(sample, levels, recall, pairs, rng) if levels else [None]
            levels -= 1

    def _grow(self, sample: np.ndarray, levels: int, recall: float, pairs: tuple, rng) -> list:
        """Trees in which enough of the pairs meet, and one beyond what was measured; none if they are too many."""
        left, right, weights = pairs
        trees, missed = [], np.arange(len(left))
        while len(trees) < MOST_TREES:
            trees.append(self._split(sample, levels, rng))
            met = np.zeros(len(left), bool)
            self._meet(trees[-1], left, right, missed, met)
            missed = missed[~met[missed]]
            if (weights[:, missed].sum(1) <= (1 - recall) * weights.sum(1)).all():
                return [*trees, self._split(sample, levels, rng)]
        return []

    def _pairs(self, x: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that trees must not part, and their weights in each measure, one measure a row.

        Rows with a vector planted at the limit, towards another row; and rows
        that have links with one of these at random, weighed by row and by the
        row's links, which stands for all linked pairs.
        """
        rows, others, links = [], [], []
        for start in range(0, len(x), PAIR_ROWS):
            near = x[start : start + PAIR_ROWS] @ x.T >= math.cos(self.angle)
            near[np.arange(len(near)), start + np.arange(len(near))] = False
            for r in np.flatnonzero(near.any(1)):
                found = np.flatnonzero(near[r])
                rows.append(start + r)
                others.append(found[rng.integers(len(found))])
                links.append(len(found))
        some = rng.permutation(len(rows))[:PAIRS]
        rows, others, links = (np.array(v, np.int64)[some] for v in (rows, others, links))
        origin, towards = x[rng.permutation(len(x))[:PAIRS]], x[rng.permutation(len(x))[:PAIRS]]
        towards = towards - (towards * origin).sum(1, keepdims=True) * origin
        sizes = np.linalg.norm(towards, axis=1)
        origin, towards = origin[sizes > 1e-9], towards[sizes > 1e-9] / sizes[sizes > 1e-9, None]
        planted = math.cos(self.angle) * origin + math.sin(self.angle) * towards
        weights = np.zeros((3, len(planted) + len(rows)))
        weights[0, : len(planted)], weights[1, len(planted) :], weights[2, len(planted) :] = 1, 1, links
        return np.concatenate([origin, x[rows]]), np.concatenate([planted, x[others]]), weights

    def _meet(self, node, a: np.ndarray, b: np.ndarray, pairs: np.ndarray, met: np.ndarray) -> None:
        """Mark the ``pairs`` of rows of ``a`` and ``b`` that share a leaf under ``node``."""
        if not len(pairs):
            return
        if node is None:
            met[pairs] = True
            return
        direction, at, low, high = node
        p, q = a[pairs] @ direction, b[pairs] @ direction
        self._meet(low, a, b, pairs[np.maximum(p, q) <= at + self.spill], met)
        self._meet(high, a, b, pairs[np.minimum(p, q) > at - self.spill], met)

    def _centres(self, x: np.ndarray) -> np.ndarray:
        """Means of groups within half the linking angle, largest first."""
        near = x @ x.T >= math.cos(self.angle / 2)
        out, left = [], np.ones(len(x), bool)
        while left.any():
            counts = (near & left).sum(1) * left
            best = int(counts.argmax())
            if counts[best] < max(8, CENTRE_SHARE * len(x)):
                break
            own = near[best] & left
            mean = x[own].mean(0)
            out.append(mean / np.linalg.norm(mean))
            left &= ~own
        return np.array(out).reshape(-1, x.shape[1])

    def _split(self, x: np.ndarray, levels: int, rng):
        if levels == 0 or len(x) < 2:
            return None
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        seen = x @ direction
        at = float(np.quantile(seen, rng.uniform(0.4, 0.6)))
        return direction, at, self._split(x[seen <= at], levels - 1, rng), self._split(x[seen > at], levels - 1, rng)

    def ball(self, x: np.ndarray) -> np.ndarray:
        """Number of the centre within half the linking angle of each vector, or -1."""
        if not len(self.centres):
            return np.full(len(x), -1)
        c = x @ self.centres.T
        return np.where(c.max(1) >= math.cos(self.angle / 2) + 1e-9, c.argmax(1), -1)

    def reaches(self, x: np.ndarray) -> np.ndarray:
        """Whether a vector can be linked with one near a centre: row by vector, column by centre."""
        return x @ self.centres.T >= math.cos(min(math.pi, 1.5 * self.angle)) - 1e-9

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """The leaves of every vector, as numbers that rise with the tree."""
        out: list[list[int]] = [[] for _ in range(len(x))]

        def down(node, rows: np.ndarray, k: int, path: int) -> None:
            if not len(rows):
                return
            if node is None:
                for r in rows:
                    out[r].append((k << 40) | path)
                return
            direction, at, low, high = node
            seen = x[rows] @ direction
            down(low, rows[seen <= at + self.spill], k, path * 2)
            down(high, rows[seen > at - self.spill], k, path * 2 + 1)

        for k, tree in enumerate(self.trees):
            down(tree, np.arange(len(x)), k, 1)
        return [sorted(one) for one in out]


def _link(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return a @ b.T >= cosine - 1e-15


def _compare(width: str, cosine: float):
    """Links inside one block, or between two; pairs count where they first meet."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        cell, one_block = key[0].as_py(), key[1].as_py() == key[2].as_py()
        order = np.array(sorted(range(len(rows)), key=rows["digest"].to_pylist().__getitem__))
        rows = rows.take(pa.array(order))
        digests, copies = rows["digest"].to_pylist(), rows["copies"].to_numpy()
        x = _unit(np.stack([np.frombuffer(v, width) for v in rows["v"].to_pylist()]))
        side = rows["part"].to_numpy()
        codes = rows["cells"].to_pylist()
        table = np.full((len(codes), max(map(len, codes))), -1, np.int64)
        for i, c in enumerate(codes):
            table[i, : len(c)] = c
        values, table = np.unique(table, return_inverse=True)
        table = table.reshape(len(codes), -1)
        earlier = (values >= 0) & (values < cell)  # cells, where a pair may have met before
        near = _link(x, x, cosine)
        np.fill_diagonal(near, False)
        if not one_block:
            near &= side[:, None] != side[None, :]
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for i in np.flatnonzero(near.any(1)):
            others = np.flatnonzero(near[i])
            mine = np.zeros(len(values), bool)
            mine[table[i]] = True
            before = (mine & earlier)[table[others]].any(1)
            links[i] = copies[others[~before]].sum()
            met = np.unique(np.append(label[others], label[i]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        out = np.flatnonzero(near.any(1))
        return pa.table({
            "digest": pa.array([digests[i] for i in out], pa.binary()), "links": pa.array(links[out], pa.int64()),
            "root": pa.array([digests[label[i]] for i in out], pa.binary()),
        })

    return compare


def _parted(placed: DataFrame, cell: str) -> DataFrame:
    """Rows of a cell dealt to blocks, each block to all pairs of blocks it belongs to: ``cell``, ``i`` <= ``j``, ``part``."""
    sizes = placed.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")).withColumnRenamed(cell, "_cell")
    dealt = placed.join(sizes, F.col(cell) == F.col("_cell")).drop("_cell")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other")


def _one_size(known: DataFrame, width: str, cosine: float, recall: float) -> DataFrame:
    """``digest``, ``links`` and ``component_id`` of the linked distinct vectors of one length."""
    spark = known.sparkSession
    t = total(known, n=F.count("*"))
    place = F.pmod(F.xxhash64("digest", F.lit(3)), F.lit(1 << 30))
    bound = int((1 << 30) * min(1.0, FIT_ROWS / max(1, t["n"])))
    sample = known.where(place < bound).select("digest", "v").collect()
    sample = _unit(np.stack([np.frombuffer(r["v"], width) for r in sorted(sample, key=lambda r: r["digest"])]))
    forest = spark.sparkContext.broadcast(Forest(sample, t["n"], cosine, recall))  # bounded by FIT_ROWS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(np.stack([np.frombuffer(v, width) for v in batch.column(1).to_pylist()]))
            ball = forest.value.ball(x)
            free = np.flatnonzero(ball < 0)
            cells: list[list[int]] = [[] for _ in range(len(x))]
            for r, c in zip(free, forest.value.leaves(x[free]), strict=True):
                cells[r] = c
            near = forest.value.reaches(x) if len(forest.value.centres) else np.zeros((len(x), 0), bool)
            probes = [[int(c) for c in np.flatnonzero(row) if b < 0 or b < c] for row, b in zip(near, ball, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ball, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(probes, pa.list_(pa.int64()))],
                names=["digest", "v", "copies", "ball", "cells", "probes"],
            )

    placed = known.select("digest", "v", "copies").mapInArrow(
        assign, "digest binary, v binary, copies long, ball long, cells array<long>, probes array<long>"
    )
    placed = materialize(placed, "forest")
    free = placed.select("digest", "v", "copies", "cells", F.explode("cells").alias("cell"))
    out = "digest binary, links long, root binary"
    found = _parted(free, "cell").groupBy("cell", "i", "j").applyInArrow(_compare(width, cosine), out)

    # Dense parts: their members are linked with each other, and compared with those outside that a link can reach.
    inside = placed.where("ball >= 0")
    balls = materialize(inside.groupBy("ball").agg(F.sum("copies").alias("c"), F.min("digest").alias("root"), F.count("*").alias("n")), "balls")
    dense = inside.join(balls, "ball").where("n > 1").select("digest", (F.col("c") - F.col("copies")).alias("links"), "root")
    probes = placed.select("digest", "v", "copies", F.explode("probes").alias("cell"))
    n_probes = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("b"))
    members = balls.select(F.col("ball").alias("cell"), F.ceil(F.col("n") / BLOCK_ROWS).alias("a")).join(n_probes, "cell")
    own = F.pmod(F.xxhash64("digest"), F.col("a"))
    theirs = F.pmod(F.xxhash64("digest"), F.col("b"))
    columns = ["digest", "v", "copies", F.array("cell").alias("cells"), "cell", "i", "j", "part"]
    left = inside.select("digest", "v", "copies", F.col("ball").alias("cell")).join(members, "cell")
    left = left.withColumns({"i": own, "j": F.explode(F.sequence(F.lit(0), F.col("b") - 1)), "part": F.lit(0)})
    right = probes.join(members, "cell").withColumns({"j": theirs, "i": F.explode(F.sequence(F.lit(0), F.col("a") - 1)), "part": F.lit(1)})
    # Two different blocks always: the second number is moved out of the first one's range.
    across = left.select(*columns).union(right.select(*columns)).withColumn("j", -1 - F.col("j"))
    across = across.groupBy("cell", "i", "j").applyInArrow(_compare(width, cosine), out)

    found = materialize(found.union(dense).union(across), "links")
    reached = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    return links.join(reached, F.col("digest") == F.col("node")).drop("node")


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """One row per row of ``vectors``: ``key``, ``n_links``, ``component_id``, ``kept``.

    Two rows are linked if the cosine of their vectors is ``cosine`` or more;
    ``recall`` is aimed at for pairs just at the limit, and closer ones miss
    less. Equal vectors are one in the forest. Vectors that are null, empty or
    zero or hold null or non-finite parts link with nothing, nor do vectors of
    different lengths. Rows with a null key are not compared; their component
    and ``kept`` are null. ``kept`` marks the smallest key of a component;
    repeated rows are copies of each other. An empty table gives an empty one.
    """
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    width = "float32" if kind == "float" else "float64"
    named = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<float>" if width == "float32" else "array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(width)
                packed.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            digests = [None if p is None else xxhash.xxh3_128_digest((np.frombuffer(p, width) + 0).tobytes()) for p in packed]
            sizes = [0 if p is None else len(p) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                names=["k", "digest", "size", "v"],
            )

    kept_type = vectors.schema[key].dataType.simpleString()
    rows = materialize(named.mapInArrow(pack, f"k {kept_type}, digest binary, size int, v binary"), "vectors")
    known = rows.where(F.col("digest").isNotNull() & F.col("k").isNotNull())
    known = known.groupBy("digest", "size").agg(F.min("k").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    known = materialize(known, "vectors")
    linked = rows.sparkSession.createDataFrame([], "digest binary, links long, component_id binary")
    for r in known.select("size").distinct().collect():  # lengths that occur, one as a rule
        linked = linked.unionByName(_one_size(known.where(F.col("size") == r["size"]), width, cosine, recall))
    linked = materialize(linked.join(known.select("digest", "first"), "digest"), "components")
    smallest = linked.groupBy("component_id").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "component_id").select("digest", "links", "smallest")
    each = known.select("digest", "first", "copies").join(linked, "digest", "left")
    component = F.coalesce("smallest", "first", "k")
    return rows.select("k", F.when(F.col("k").isNotNull(), F.col("digest")).alias("digest")).join(each, "digest", "left").select(
        F.col("k").alias(key), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"), (F.col("k") == component).alias("kept"),
    )
