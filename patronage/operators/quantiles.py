"""Quantile codes, thresholds and the quantile-to-normal map."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from patronage.operators.selection import MAX_CANDIDATES, order_statistics, quantiles, scalars

QUINTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def bin_edges(df: DataFrame, columns: list[str], probs=QUINTILES, max_candidates: int = MAX_CANDIDATES):
    """Distinct quantile edges per column (empty for an all-null column)."""
    values = quantiles(df, {c: list(probs) for c in columns}, max_candidates)
    return {c: sorted({v for v in vs if v is not None}) for c, vs in values.items()}


def bin_code(c: Column, edges: list[float]) -> Column:
    """0-based bin of ``c``: right-closed, lowest value included, null stays null.

    Fewer than two edges leave no bin at all, so the code is null.
    """
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inner = [(c > F.lit(e)).cast("int") for e in edges[1:-1]]
    code = reduce(lambda a, b: a + b, inner, F.lit(0))
    return F.when(c.isNotNull(), code)


def with_quintiles(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add a quintile code column ``columns[c]`` for each metric ``c``."""
    edges = bin_edges(df, list(columns))
    return df.withColumns({out: bin_code(F.col(c), edges[c]) for c, out in columns.items()})


def sorted_value_at(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Value at sorted position ``int(n * share)`` for each share."""
    n = scalars(df, n=F.count(column))["n"]
    ranks = [int(n * s) for s in shares]
    found = order_statistics(df, {column: ranks}, {column: n})[column]
    return [found[r] for r in ranks]


def above_quantile(df: DataFrame, column: str, p: float = 0.75) -> DataFrame:
    """Rows strictly above the quantile."""
    edge = quantiles(df, {column: [p]})[column][0]
    return df.where(F.col(column) > F.lit(edge))


# --- quantile-to-normal map -------------------------------------------------

# Coefficients of Wichura's published algorithm AS 241 (PPND16).
_CENTRE_NUM = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
               45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727]
_CENTRE_DEN = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
               21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610]
_NEAR_NUM = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
             1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4]
_NEAR_DEN = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
             0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
_FAR_NUM = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
            0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
_FAR_DEN = [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile of each probability."""
    def ratio(x, num, den):
        return np.polyval(num[::-1], x) / np.polyval(den[::-1], x)

    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    outer = np.where(tail <= 5, ratio(tail - 1.6, _NEAR_NUM, _NEAR_DEN), ratio(tail - 5, _FAR_NUM, _FAR_DEN))
    return np.where(np.abs(q) <= 0.425, q * ratio(0.180625 - q * q, _CENTRE_NUM, _CENTRE_DEN), np.sign(q) * outer)


def apply_normal_map(df: DataFrame, marks: dict[str, list[float]], suffix: str = "_normal") -> DataFrame:
    """Map each fitted column onto a standard normal; null stays null."""
    names = list(marks)
    tables = {c: np.asarray(v) for c, v in marks.items()}
    shape = T.StructType([T.StructField(c, T.DoubleType()) for c in names])

    @F.pandas_udf(shape)
    def squash(block: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for c in names:
            x, q = block[c].to_numpy(dtype=float), tables[c]
            refs = np.linspace(0, 1, len(q))
            # Average of the ascending and descending walk: ties land mid-step.
            share = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
            share = np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, share))
            out[c] = inverse_normal(np.clip(share, 1e-7, 1 - 1e-7))
        return pd.DataFrame(out).where(block[names].notna().to_numpy())

    mapped = df.withColumn("_mapped", squash(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))
    return mapped.withColumns({f"{c}{suffix}": F.col(f"_mapped.{c}") for c in names}).drop("_mapped")
