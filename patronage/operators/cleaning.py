"""Row cleaning, filters and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from patronage.functions.scalar import (
    as_money, as_percent, dtype, instant, is_numeric, is_temporal, parse_instant, parse_number, upper_trimmed, whole_days,
)
from patronage.operators.joins import join_one
from patronage.operators.selection import scalars


class EmptyInput(ValueError):
    """A table that must have rows has none."""


def require_rows(*frames: DataFrame, message: str = "empty input") -> None:
    for df in frames:
        if df.isEmpty():
            raise EmptyInput(message)


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def positive_amounts(df: DataFrame, column: str = "amount") -> DataFrame:
    return df.where(F.col(column) > 0)


def with_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Parse date columns; what cannot be read becomes null."""
    return df.withColumns({c: parse_instant(F.col(c), dtype(df, c)) for c in columns})


def with_numbers(df: DataFrame, columns: dict[str, float | None]) -> DataFrame:
    """Parse numbers; what cannot be read (or is no number) becomes the given default, or null."""
    new = {}
    for c, default in columns.items():
        n = F.col(c).cast("double") if is_numeric(dtype(df, c)) else parse_number(F.col(c))
        n = F.nanvl(n, F.lit(None).cast("double"))
        new[c] = n if default is None else F.coalesce(n, F.lit(float(default)))
    return df.withColumns(new)


def clean_country(df: DataFrame, column: str = "country") -> DataFrame:
    return df.withColumn(column, upper_trimmed(F.col(column)))


def clean_and_join(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Both tables cleaned and joined at transaction grain; an empty result is an error."""
    require_rows(customers, transactions)
    customers = with_dates(drop_incomplete(customers, ["customer_id"]), "signup_date")
    transactions = with_dates(drop_incomplete(transactions, ["customer_id", "amount"]), "date")
    joined = join_one(transactions, customers, validate=True)
    require_rows(joined, message="no transaction has a customer")
    return clean_country(positive_amounts(joined))


def days_as_integer(df: DataFrame, as_of, column: str = "days_since_last_purchase") -> DataFrame:
    """Whole days: a timestamp becomes its age, anything unreadable becomes 0."""
    if column not in df.columns:
        return df
    t = dtype(df, column)
    if is_temporal(t):
        days = whole_days(F.col(column), as_of)
    else:
        n = F.col(column).cast("double") if is_numeric(t) else parse_number(F.col(column))
        days = F.coalesce(n, F.lit(0.0)).cast("long")
    return df.withColumn(column, days)


def last_activity_day(df: DataFrame) -> DataFrame:
    """``last_activity`` from ``last_purchase``, which is then dropped."""
    if "last_purchase" not in df.columns:
        return df
    if "last_activity" not in df.columns:
        when = parse_instant(F.col("last_purchase"), dtype(df, "last_purchase"))
        df = df.withColumn("last_activity", when.cast("date"))
    return df.drop("last_purchase")


def timestamps_to_text(df: DataFrame) -> DataFrame:
    new = {
        f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    }
    return df.withColumns(new) if new else df


def fill_report_nulls(df: DataFrame) -> DataFrame:
    texts = [c for c in ("country", "gender", "revenue_segment") if c in df.columns]
    return df.na.fill("Unknown", subset=texts) if texts else df


def fill_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers without nulls; a column the table lacks is added as 0."""
    new = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns}
    return df.withColumns(new)


def select_values(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Keep rows whose value is among the chosen ones; no choice means no filter."""
    for column, values in choices.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def date_bounds(df: DataFrame, column: str, today) -> tuple:
    """First and last day present, else the 365 days up to ``today``."""
    s = scalars(df, lo=F.min(F.to_date(column)), hi=F.max(F.to_date(column)))
    if s["lo"] is not None:
        return s["lo"], s["hi"]
    import datetime as dt

    day = today.date() if isinstance(today, dt.datetime) else today
    return day - dt.timedelta(days=365), day


def between_dates(df: DataFrame, column: str, start, end, keep_null_dates: bool = False) -> DataFrame:
    """Inclusive range of instants; rows without a date are dropped by default."""
    c = F.col(column)
    inside = (c >= instant(start)) & (c <= instant(end))
    return df.where(inside | c.isNull()) if keep_null_dates else df.where(inside)


def for_tenant(df: DataFrame, user_id: str) -> DataFrame:
    """Rows of the tenant; a table without tenants becomes the tenant's."""
    if "user_id" not in df.columns:
        return df.withColumn("user_id", F.lit(user_id))
    return df.where(F.col("user_id") == F.lit(user_id))


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a filter dimension."""
    return df.select(column).distinct().orderBy(column)


def display_formats(df: DataFrame, percents=(), moneys=(), symbol: str = "$") -> DataFrame:
    new = {f"{c}_text": as_percent(F.col(c)) for c in percents}
    new.update({f"{c}_text": as_money(F.col(c), symbol) for c in moneys})
    return df.withColumns(new)
