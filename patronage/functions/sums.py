"""Sums of binary fractions that do not depend on the order of the rows.

A double is cut, by its bits, into whole numbers for a fixed row of bins, each
``WIDTH`` bits wide. Sums of whole numbers are exact in any order, so a retried
task, another partition count or another order of joins gives the very same
total; the bins of a group are put together once, at the end, and rounded to
a double there. A bin holds the sums of over 10**11 rows; beyond that ANSI
arithmetic raises instead of wrapping.

The bins reach from 2**-156 to 2**130, about 1e-47 to 1e39, so 1e33 and 1e-30
add up without loss. What lies outside is not lost either: amounts of 1e39
and more, infinities among them, and bits below 1e-47 are added as doubles beside
the bins. NaN is no amount: it is left out, of the sum and of ``amounts`` alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from patronage.functions.scalar import dtype

WIDTH, LOW_BIT, BINS = 26, -156, 11
_UNIT = float(1 << WIDTH)
_TOP = 2.0 ** (LOW_BIT + WIDTH * BINS)


def is_binary(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.FloatType, T.DoubleType))


def amount(df: DataFrame, name: str) -> Column:
    """The column with NaN, which is no amount, as null."""
    c = F.col(name)
    return F.when(~F.isnan(c), c.cast("double")) if is_binary(df, name) else c


def amounts(df: DataFrame, name: str) -> Column:
    """How many rows of a group hold an amount."""
    return F.count(amount(df, name))


def _piece(x: Column, place: int) -> Column:
    """The bits of ``x`` that belong to one bin, as a whole number with the sign of ``x``.

    Scaling by a power of two and the remainder are exact. A double has bits in
    four bins at most; the others are skipped.
    """
    bit, size = LOW_BIT + WIDTH * place, F.abs(x)
    here = (size >= 2.0**bit) & (size < 2.0 ** (bit + WIDTH + 53)) & (size < _TOP)
    return F.when(here, (x * (2.0**-bit) % _UNIT).cast("long"))


def _outside(x: Column) -> Column:
    """What no bin holds: amounts above all bins as they are, else the bits below all bins."""
    size = F.abs(x)
    return F.when(size >= _TOP, x).when(size < 2.0 ** (LOW_BIT + 53), x * (2.0**-LOW_BIT) % 1.0 * 2.0**LOW_BIT)


def _joined(bins: Column) -> Column:
    """``carry`` above the highest bin and ``rest`` below it, in units of that bin's upper end.

    From the lowest bin upwards each keeps its remainder and hands the whole
    units on, so that all remainders are positive and only the last addition
    rounds at the size of the total.
    """
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit(0.0).alias("rest"))
    unit = F.lit(1 << WIDTH).cast("long")

    def step(done: Column, bin_: Column) -> Column:
        n = done["carry"] + bin_
        return F.struct(F.shiftright(n, WIDTH).alias("carry"), ((done["rest"] + F.pmod(n, unit)) / _UNIT).alias("rest"))

    return F.aggregate(bins, start, step)


def _value(joined: Column) -> Column:
    return (joined["carry"] + joined["rest"]) * _TOP


def exact_sum(x: Column) -> Column:
    """Aggregate: the sum of a double column, null if it has no value; NaN must be null in it (see ``amount``)."""
    bins = F.array(*[F.coalesce(F.sum(_piece(x, k)), F.lit(0)) for k in range(BINS)])
    joined = _joined(bins)
    # Of a negative total the opposite is put together, as remainders near one would cancel against the carry.
    inside = F.when(joined["carry"] < 0, -_value(_joined(F.transform(bins, lambda b: -b)))).otherwise(_value(joined))
    return F.when(F.count(x) > 0, inside + F.coalesce(F.sum(_outside(x)), F.lit(0.0)))


def exact_total(df: DataFrame, name: str) -> Column:
    """Aggregate: the sum of a column, 0 where there is nothing to add; see the top of this module."""
    if is_binary(df, name):
        return F.coalesce(exact_sum(amount(df, name)), F.lit(0.0))
    return F.coalesce(F.sum(name), F.lit(0))


def exact_mean(df: DataFrame, name: str) -> Column:
    """Aggregate: the mean of a column's amounts, null if it has none."""
    return F.when(amounts(df, name) > 0, exact_total(df, name).cast("double") / amounts(df, name))
