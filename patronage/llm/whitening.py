"""Whitening of embeddings by spectral divide and conquer over polar decompositions.

Entries become whole numbers, so moments are exact and do not depend on the
order in which tasks add them up. Every distinct vector counts once. Tasks
give the sums and, centred at the whole numbers next to the means, the
products of their vectors; partial products are added up in two levels, by
rows of the matrix. What is left of the mean is taken off in exact integers.

The covariance, whose size is that of the dimension and not of the data, is
split on the driver: the unitary polar factor of ``V - shift`` is its matrix
sign, half of one plus it projects on the components above the shift, and bases
of that subspace and of its complement split the matrix in two blocks, which
are split in turn down to single components. The polar factor comes from the
dynamically weighted Halley iteration in its QR form (QDWH), so only stable
factorisations are used. Components and means then go to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from patronage.llm.common import fresh
from patronage.session import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows of the matrix of products that are added up together.
BLOCK = 64
#: Partial matrices that one task of the first level adds up.
FAN_IN = 32
EPS = np.finfo(float).eps


# --- moments -------------------------------------------------------------------


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The vectors of each batch (its first column) as a matrix of whole numbers."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy().reshape(-1, dim)


def exact_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each entry, through two sums of 32-bit halves a task."""

    def partial(batches):
        n, low, high = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for x in matrices(batches, dim):
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(0)
            high += (x >> 32).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n] * dim, "i": range(dim), "low": low, "high": high}, schema=schema)

    schema = pa.schema([("n", pa.int64()), ("i", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
    parts = vectors.mapInArrow(partial, "n long, i int, low long, high long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high")]
    rows = sorted(parts.groupBy("i").agg(*wide).collect(), key=lambda r: r.i)  # one row per dimension
    return (int(rows[0].n) if rows else 0), [int(r.low) + (int(r.high) << 32) for r in rows]


def summed_blocks(vectors: DataFrame, dim: int, values, width: int) -> np.ndarray:
    """The sum over all vectors of the products of ``values(matrix)`` with itself, a square matrix of ``width``.

    Each task gives its own sum in blocks of rows; ``FAN_IN`` tasks' blocks are
    added by one task, then those sums, a block at a time.
    """
    blocks = math.ceil(width / BLOCK)

    def partial(batches):
        products = np.zeros((width, width))
        for x in matrices(batches, dim):
            for at in range(0, len(x), 4096):
                z = values(x[at : at + 4096])
                products += z.T @ z
        part = TaskContext.get().partitionId() // FAN_IN
        cut = [products[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in range(blocks)]
        yield pa.RecordBatch.from_pydict({"part": [part] * blocks, "block": range(blocks), "sums": cut}, schema=schema)

    def add(key, table):
        sums = 0
        for cell in table.column("sums"):
            sums = sums + np.frombuffer(cell.as_py())
        return pa.table({"part": [-1], "block": [key[-1].as_py()], "sums": [sums.tobytes()]}, schema=schema)

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())])
    parts = vectors.mapInArrow(partial, "part int, block int, sums binary")
    for keys in (("part", "block"), ("block",)):
        parts = parts.groupBy(*keys).applyInArrow(add, "part int, block int, sums binary")
    rows = sorted(parts.collect(), key=lambda r: r.block)  # one matrix, whatever the number of vectors
    return np.concatenate([np.frombuffer(r.sums) for r in rows]).reshape(width, width)


def covariance(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, centred before multiplying.

    Products are of whole numbers next to zero: exact in doubles while a sum
    stays under 2**53. The rest of each mean is a fraction with divisor ``n``.
    """
    centre = np.array([s // n for s in sums], np.int64)
    products = summed_blocks(vectors, dim, lambda x: (x - centre).astype(float), dim)
    rest = [(s - n * (s // n)) / n for s in sums]
    return products / n - np.outer(rest, rest)


# --- polar decomposition and splitting -------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The symmetric unitary polar factor of symmetric ``a``: its matrix sign.

    Each step maps the singular values by a rational function whose weights
    follow a lower bound of them, here begun at the rounding level: at most
    about eight steps bring all to one.
    """
    n = len(a)
    x, low = a / np.abs(a).sum(0).max(), EPS  # singular values are at most the largest sum of a column
    eye = np.eye(n)
    for _ in range(40):
        square = low * low
        root = (4 * (1 - square) / (square * square)) ** (1 / 3)
        wide = math.sqrt(1 + root)
        wa = wide + 0.5 * math.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - square) / (square * wide)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        after = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * q[:n] @ q[n:].T
        after = (after + after.T) / 2
        moved, x = np.abs(after - x).max(), after
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if 1 - low < 8 * EPS and moved < 1e-14 * n:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the projector's range and of its complement, from the images of fixed random columns, twice."""
    columns = np.random.default_rng(rank).standard_normal((len(projector), rank))
    for _ in range(2):
        q, _ = np.linalg.qr(projector @ columns, mode="complete")
        columns = q[:, :rank]
    return columns, q[:, rank:]


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of ``a``, or None where all its eigenvalues agree to rounding.

    The shift lies between eigenvalues: the median of the diagonal, else the
    mean, else places beside them. A shift that meets an eigenvalue gives no
    projector and is passed over.
    """
    n, scale = len(a), np.abs(a).max()
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / math.sqrt(n)  # of the eigenvalues around their mean
    if spread <= 4 * EPS * max(scale, abs(mean)):
        return None
    best, error = None, np.inf
    for shift in (np.median(np.diag(a)), mean, *(mean + spread * f for f in (0.05, -0.05, 0.2, -0.2, 0.5, -0.5))):
        moved = a - shift * np.eye(n)
        if not moved.any():
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        above, below = _bases(projector, rank)
        off = np.abs(above.T @ a @ below).max() / scale  # what the split leaves between the two
        if off < error:
            best, error = (above, below), off
        if error < 64 * EPS * math.sqrt(n):
            break
    return best


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of symmetric ``a``, falling, and unit eigenvectors as columns.

    Invariant subspaces are split until each is one component wide or its
    eigenvalues agree to rounding, so that any basis of it serves. The entry of
    largest size of each vector is positive.
    """
    n = len(a)
    a = (a + a.T) / 2
    done, open_ = [], [(np.eye(n), a)] if n else []
    while open_:
        basis, block = open_.pop()
        halves = _split(block) if len(block) > 1 else None
        if halves is None:
            done.append(basis)
            continue
        for half in halves:
            q, _ = np.linalg.qr(basis @ half)
            inner = q.T @ a @ q
            open_.append((q, (inner + inner.T) / 2))
    vectors = np.hstack(done) if done else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(n)]) if n else 1
    return values, vectors * signs


# --- the operator ------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the entries of ``(n*x - S)**2``, exact; 64-bit numbers where they suffice."""
    dim, most = x.shape[1], n * max(int(np.abs(x).max()), 1) if x.size else 0
    if most + max(map(abs, sums), default=0) < 1 << 62:
        away = n * x - np.array(sums, np.int64)
        if dim * int(np.abs(away).max(initial=0)) ** 2 < 1 << 63:
            return (away * away).sum(1).tolist()
        away = away.astype(object)
    else:
        away = n * x.astype(object) - np.array(sums, object)
    return (away * away).sum(1).tolist()


def whiten(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Every row with a usable vector once per component, with its whitened coordinate.

    Adds ``component`` (from 1 by falling eigenvalue, at most ``most``), ``n``
    (distinct vectors fitted), ``deviation`` (decimal, exact squared distance
    from the mean times ``n`` squared), ``whitened`` (projection over the square
    root of the eigenvalue), ``explained`` (share of the eigenvalue in the
    trace) and ``identity_error`` (largest entry of the whitened covariance
    minus the identity, over all components given).

    Rows whose vector is null, or has a null or non-finite entry, or one of
    2**56 or more (its whole number fits no 64 bits), are dropped; so are empty
    vectors and those not of the commonest length (of tied lengths the larger),
    which share no covariance with the rest. Repeated rows and vectors are
    fitted once and all given. Components without variance, to rounding,
    have no whitened coordinate and are left out: a table of one vector, like an
    empty one, gives no rows. Equal eigenvalues keep an order of the
    solver's. Other columns pass through; those named like an output are
    replaced.
    """
    outputs = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    whole, fitted = fresh("whole", df, outputs), fresh("fitted", df, outputs)
    spark = df.sparkSession
    entry = F.col(vector)
    usable = entry.isNotNull() & F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 56), F.lit(False)))  # NaN is above all
    numbers = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    # The filter stands inside the expression: none of its readers can meet an entry that is not usable.
    rows = df.withColumn(whole, F.when(F.coalesce(usable, F.lit(False)), numbers)).where(F.size(whole) > 0)
    lengths = rows.groupBy(F.size(whole).alias("dim")).count()
    commonest = lengths.agg(F.max_by("dim", F.struct("count", "dim")).alias("dim")).first()
    dim = commonest.dim or 0
    rows = rows.where(F.size(whole) == dim)
    vectors = materialize(rows.select(whole).distinct(), "whole-vectors")
    n, sums = exact_sums(vectors, dim)
    variance = covariance(vectors, dim, n, sums) if n else np.zeros((0, 0))
    values, axes = spectral_components(variance)
    trace = float(np.trace(variance))
    keep = values > values.max(initial=0.0) * dim * EPS * 1000
    values, axes = values[keep][:most], axes[:, keep][:, :most]
    mean = np.array([s // n for s in sums], np.int64) if n else np.zeros(0, np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums]) if n else np.zeros(0)
    model = spark.sparkContext.broadcast((axes / np.sqrt(values), mean, rest, n, sums))  # of the dimension's size

    def white(x: np.ndarray) -> np.ndarray:
        scaled, centre, fraction, *_ = model.value
        return ((x - centre) - fraction) @ scaled

    error = 0.0
    if k := len(values):
        # One more column of ones gives the means of the coordinates, which are taken off.
        moments = summed_blocks(vectors, dim, lambda x: np.hstack([white(x), np.ones((len(x), 1))]), k + 1) / n
        error = float(np.abs(moments[:k, :k] - np.outer(moments[:k, k], moments[:k, k]) - np.eye(k)).max())

    @F.arrow_udf("struct<deviation string, whitened array<double>>")
    def coordinates(lists: pa.Array) -> pa.Array:
        x = lists.flatten().to_numpy().reshape(-1, dim)
        away = deviations(x, model.value[3], model.value[4])
        flat, ends = pa.array(white(x).ravel()), pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
        return pa.StructArray.from_arrays([pa.array(map(str, away), pa.string()), pa.ListArray.from_arrays(ends, flat)], ["deviation", "whitened"])

    carried = [c for c in df.columns if c not in outputs]
    shares = F.array(*[F.lit(float(v) / trace) for v in values]).cast("array<double>")
    computed = rows.withColumn(fitted, coordinates.asNondeterministic()(F.col(whole))) if k else rows.withColumn(
        fitted, F.lit(None).cast("struct<deviation: string, whitened: array<double>>")
    )
    place, value = (fresh(c, df, [*outputs, whole, fitted]) for c in ("place", "value"))
    out = computed.select("*", F.posexplode(f"{fitted}.whitened").alias(place, value))
    return out.select(
        *carried, (F.col(place) + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col(f"{fitted}.deviation").cast("decimal(38,0)").alias("deviation"),
        F.col(value).alias("whitened"), F.get(shares, F.col(place)).alias("explained"), F.lit(error).alias("identity_error"),
    )
