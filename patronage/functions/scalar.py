"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Date layouts accepted besides the ISO forms that a cast reads,
# each with the shape of the texts it is tried on.
DATE_LAYOUTS = {
    "yyyyMMdd": r"^\d{8}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy/M/d H:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
}

# The blanks removed at both ends of a text.
BLANKS = " \t\n\r\x0b\x0c"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, TEMPORAL)


def instant(value) -> Column:
    """A zone-free timestamp from a Python value or a column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def whole_days(start: Column, end) -> Column:
    """Whole 24-hour units from ``start`` to ``end``, rounded down."""
    gap = instant(end) - start.cast("timestamp_ntz")
    days = F.extract(F.lit("DAY"), gap).cast("long")
    return days - F.when(gap < F.make_dt_interval(days.cast("int")), 1).otherwise(0)


def at_least(c: Column, floor: float) -> Column:
    """``max(c, floor)`` that stays null for a null ``c``."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def parse_number(c: Column) -> Column:
    """Number from text, null when it is none.

    Only what begins like a number is cast: a failing cast throws inside the JVM.
    """
    return F.when(c.rlike(r"^\s*[+-]?(\.?\d|[iI]nf)"), c.try_cast("double"))


def parse_instant(c: Column, t: T.DataType | None = None) -> Column:
    """Timestamp from text (or a date / timestamp), null when it is none."""
    if t is not None and is_temporal(t):
        return c.cast("timestamp_ntz")
    text = F.btrim(c, F.lit(BLANKS))
    # A layout is tried only on texts of its shape: a failing parse throws inside
    # the JVM, which would cost far more than the shape test on dirty columns.
    iso = text.try_cast("timestamp_ntz")
    parsed = F.lit(None).cast("timestamp_ntz")
    for layout, shape in reversed(DATE_LAYOUTS.items()):
        parsed = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")).otherwise(parsed)
    return F.when(text.rlike("|".join(DATE_LAYOUTS.values())), parsed).otherwise(iso)


def upper_trimmed(c: Column) -> Column:
    return F.btrim(F.upper(c), F.lit(BLANKS))


def as_percent(c: Column) -> Column:
    """``0.1234`` -> ``12.3%``."""
    # A decimal pattern rounds the exact binary value; a printf format would not.
    return F.concat(F.call_function("format_number", c * 100, F.lit("0.0")), F.lit("%"))


def as_money(c: Column, symbol: str = "$") -> Column:
    """``1234.5`` -> ``$1,234.50``."""
    return F.concat(F.lit(symbol), F.format_number(c.cast("double"), 2))


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def keyed_normal(key: Column, seed: int) -> Column:
    """Standard normal draw that depends on the row's key and seed alone.

    Two hash uniforms through Box-Muller, so the value does not move with
    partitioning, task retries or row order.
    """
    span = float(2**53)

    def uniform(k: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(k)), 11)
        return (bits.cast("double") + 0.5) / span

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2.0 * F.lit(3.141592653589793) * uniform(2))
