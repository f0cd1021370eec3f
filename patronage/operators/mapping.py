"""Column recognition, role mapping, renaming and projection."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from patronage.functions.scalar import is_numeric, is_temporal, parse_instant, parse_number
from patronage.operators.joins import join_one
from patronage.operators.selection import scalars, with_row_index

# Name fragments of each semantic type, in the order they are tried.
ID_WORDS = ["id", "customer", "client", "user", "member", "account"]
DATE_WORDS = ["date", "time", "created", "purchased", "transaction", "order", "billing", "payment"]
AMOUNT_WORDS = ["amount", "price", "value", "cost", "revenue", "total", "sum", "payment", "charge", "fee"]
NAME_WORDS = ["name", "first", "last", "full", "customer", "client"]
PLACE_WORDS = ["country", "city", "state", "region", "location", "address", "zip", "postal"]
CATEGORY_WORDS = ["category", "type", "class", "group", "product", "item", "service"]
AGE_WORDS = ["age", "dob", "birth", "year"]
GENDER_WORDS = ["gender", "sex"]
GENDER_VALUES = ["m", "f", "male", "female"]

# The roles a table can fill, and accepted column names of the churn input.
ROLES = ["customer_id", "date", "amount", "customer_name", "age", "gender", "location", "category"]
REQUIRED_ROLES = ["customer_id", "date", "amount"]
ALIASES = {
    "amount": ["amount", "value", "price", "revenue", "total_spent"],
    "transaction_count": ["transaction_count", "num_orders", "order_count", "purchases"],
    "days_since_last_purchase": ["days_since_last_purchase", "last_purchase_days_ago", "days_since_order"],
    "customer_id": ["customer_id", "user_id", "client_id"],
    "age": ["age", "customer_age"],
    "gender": ["gender", "sex", "customer_gender"],
}

# Currency signs looked for, in this order.
CURRENCY_SIGNS = list("$₹€£¥₩₽₺₪₫฿₴₦₲₵₡₱₸₭₮₯₠₢₣₤₧₨")

# Columns of the stored tables, and of the reports built on them.
CHURN_COLUMNS = ["user_id", "analysis_id", "customer_id", "churn_probability", "risk_level", "total_amount",
                 "transaction_count", "days_since_last_purchase", "last_activity"]
REVENUE_COLUMNS = ["user_id", "customer_id", "analysis_id", "predicted_revenue", "total_revenue",
                   "revenue_segment", "transaction_count", "avg_transaction_value"]
CUSTOMER_COLUMNS = ["user_id", "analysis_id", "customer_id", "customer_name", "age", "gender", "country",
                    "total_spent", "transaction_count", "first_purchase_date", "last_purchase_date"]
REPORT_TEXTS = ["country", "gender", "risk_level", "revenue_segment"]
REPORT_NUMBERS = ["total_revenue"]
COMPLETENESS_COLUMNS = ["country", "gender", "last_purchase_date", "total_revenue"]
DATE_NAME_PARTS = ["date", "purchase", "order", "last"]


# --- semantic column types ---------------------------------------------------


NESTED = (T.ArrayType, T.MapType, T.StructType)


@dataclass(frozen=True)
class ColumnStats:
    """What the type rules need to know about one column's non-null values."""

    rows: int
    distinct: int
    numbers: int
    dates: int
    low: float | None
    high: float | None
    ages: int
    genders: int
    data_type: T.DataType


def _has(name: str, words: list[str]) -> bool:
    return any(w in name for w in words)


def semantic_type(name: str, s: ColumnStats) -> str:
    """Type of a column from its name and its values; the first rule that fits wins."""
    if isinstance(s.data_type, NESTED):
        return "unknown"
    name = name.lower()
    mostly_unique = s.distinct > s.rows * 0.8
    rules = [
        ("customer_id", _has(name, ID_WORDS) and mostly_unique),
        ("date", _has(name, DATE_WORDS) and s.dates == s.rows),
        ("amount", _has(name, AMOUNT_WORDS) and s.numbers > 0),
        ("customer_name", _has(name, NAME_WORDS)),
        ("location", _has(name, PLACE_WORDS)),
        ("category", _has(name, CATEGORY_WORDS)),
        ("age", _has(name, AGE_WORDS) and s.ages > 0),
        ("gender", _has(name, GENDER_WORDS) and s.genders > 0),
    ]
    for label, fits in rules:
        if fits:
            return label
    if is_numeric(s.data_type) and not isinstance(s.data_type, T.DecimalType):
        positive = s.low is not None and s.low > 0 and s.high < 1_000_000
        return "amount" if positive else "numeric"
    if is_temporal(s.data_type):
        return "date"
    if s.distinct < s.rows * 0.3:
        return "category"
    return "customer_id" if mostly_unique else "unknown"


def _number(c: Column, t: T.DataType) -> Column:
    if is_numeric(t):
        return c.cast("double")
    return parse_number(c) if isinstance(t, T.StringType) else F.lit(None).cast("double")


def _is_date(c: Column, t: T.DataType) -> Column:
    # Numbers count as dates: they read as time since the epoch.
    if is_numeric(t) or is_temporal(t):
        return c.isNotNull()
    return parse_instant(c).isNotNull() if isinstance(t, T.StringType) else F.lit(False)


def _stats_aggs(name: str, t: T.DataType, any_name: bool) -> dict[str, Column]:
    """Aggregates of one column; a probe only a name can call for is left out for other names."""
    c = F.col(name)
    number = _number(c, t)
    name = name.lower()
    no = F.max(F.lit(0).cast("long"))
    return {
        "rows": F.count(c),
        "numbers": F.count(number),
        "dates": F.count_if(_is_date(c, t)) if any_name or _has(name, DATE_WORDS) else no,
        "low": F.min(number),
        "high": F.max(number),
        "ages": F.count_if(number.between(15, 100)) if _has(name, AGE_WORDS) else no,
        "genders": F.count_if(F.lower(c.cast("string")).isin(GENDER_VALUES)) if _has(name, GENDER_WORDS) else no,
    }


SKETCH_BITS = 14
UNIQUENESS_ERROR = 0.01  # above the sketch's standard error at that size
UNIQUENESS_CUTS = (0.3, 0.8)


def column_stats(df: DataFrame, any_name: bool = False) -> dict[str, ColumnStats]:
    """Statistics of every column over all rows: one scan, no shuffle of the rows.

    ``any_name`` tries every column as a date, whatever its name.

    Distinct counts start as sketches. Only a column whose estimate lies within
    five standard errors of a share the rules compare with is counted exactly.
    """
    nested = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, NESTED)}
    fields = [f for f in df.schema.fields if f.name not in nested]
    aggs: dict[str, Column] = {f"nested_{i}": F.count(F.col(f"`{n}`")) for i, n in enumerate(nested)}
    for i, f in enumerate(fields):
        for k, a in _stats_aggs(f.name, f.dataType, any_name).items():
            aggs[f"{k}_{i}"] = a
        aggs[f"distinct_{i}"] = F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f.name).cast("string"), SKETCH_BITS))
    row = scalars(df, **aggs)
    close = [
        i
        for i in range(len(fields))
        if any(abs(row[f"distinct_{i}"] - cut * row[f"rows_{i}"]) <= 5 * UNIQUENESS_ERROR * row[f"distinct_{i}"]
               for cut in UNIQUENESS_CUTS)
    ]
    for i in close:  # one exact count per doubtful column keeps each shuffle to that column
        row[f"distinct_{i}"] = scalars(df, d=F.count_distinct(fields[i].name))["d"]
    found = {f.name: _column_stats(row, i, f.dataType) for i, f in enumerate(fields)}
    # Of nested columns only the filled rows are counted; they never are a number or a date.
    found |= {n: ColumnStats(row[f"nested_{i}"], 0, 0, -1, None, None, 0, 0, t) for i, (n, t) in enumerate(nested.items())}
    return {f.name: found[f.name] for f in df.schema.fields}


def _column_stats(row, i, t: T.DataType) -> ColumnStats:
    keys = ("rows", "distinct", "numbers", "dates", "low", "high", "ages", "genders")
    return ColumnStats(*[row[f"{k}_{i}"] for k in keys], data_type=t)


def sample_stats(df: DataFrame, order_by: str | None = None, size: int = 100) -> dict[str, ColumnStats]:
    """Statistics of each column's first ``size`` non-null values by ``order_by``.

    The first ``size`` rows serve every column that is filled there; only a
    column with gaps among them is looked up by itself. Without ``order_by``
    the rows come as the files are read, and only the first files are opened.
    """
    def head(rows: DataFrame) -> DataFrame:
        picked = (rows.orderBy(order_by) if order_by else rows).limit(size).collect()  # at most ``size`` rows
        return df.sparkSession.createDataFrame(picked, rows.schema)

    first = head(df)
    out = column_stats(first)
    filled = max((s.rows for s in out.values()), default=0)
    for f in df.schema.fields:
        if f.name in out and out[f.name].rows < min(size, filled):
            columns = list(dict.fromkeys([f.name] + ([order_by] if order_by else [])))
            alone = head(df.select(*columns).where(F.col(f.name).isNotNull()))
            out[f.name] = column_stats(alone.select(f.name))[f.name]
    return out


def describe_types(df: DataFrame, stats: dict[str, ColumnStats]) -> DataFrame:
    """One row per column: its statistics and recognised type."""
    rows = [(n, s.rows, s.numbers, s.low, s.high, semantic_type(n, s)) for n, s in stats.items()]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, non_null long, numbers long, low double, high double, semantic_type string"
    )


def auto_map(df: DataFrame, order_by: str | None = None) -> dict[str, str | None]:
    """Pick a column for each role; three roles have a fallback on the full data."""
    types = {n: semantic_type(n, s) for n, s in sample_stats(df, order_by).items()}
    full: dict[str, ColumnStats] = {}
    chosen: dict[str, str | None] = {}
    fallbacks = {
        "customer_id": lambda s, n: s.distinct > n * 0.8,
        "date": lambda s, n: s.dates == s.rows,
        "amount": lambda s, n: s.numbers > 0 and s.low > 0,
    }
    for role in ROLES:
        chosen[role] = next((n for n, t in types.items() if t == role), None)
        if chosen[role] is None and role in fallbacks:
            if not full:
                full = column_stats(df, any_name=True)
                rows = df.count()
            chosen[role] = next((n for n, s in full.items() if fallbacks[role](s, rows)), None)
    return chosen


# --- renaming, defaults, projection -------------------------------------------


def rename_roles(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Rename mapped columns to their role; unset roles change nothing."""
    return df.withColumnsRenamed({old: role for role, old in mapping.items() if old})


def alias_columns(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Copy the first existing alias to each absent target column."""
    new = {}
    for target, names in aliases.items():
        source = next((n for n in names if n in df.columns), None)
        if target not in df.columns and source:
            new[target] = F.col(source)
    return df.withColumns(new) if new else df


def customer_defaults(df: DataFrame) -> DataFrame:
    """Absent optional customer columns become null columns."""
    kinds = {"customer_name": "string", "age": "int", "gender": "string", "location": "string"}
    new = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def transaction_defaults(df: DataFrame) -> DataFrame:
    """Absent category becomes the general one."""
    return df if "category" in df.columns else df.withColumn("category", F.lit("General"))


def number_customers(df: DataFrame, order_by: list, name: str = "customer_id") -> DataFrame:
    """Add ids 1..n along ``order_by`` if the table has none."""
    return df if name in df.columns else with_row_index(df, order_by, name, start=1)


def ids_by_position(customers: DataFrame, order_by: list, transactions: DataFrame, seen_by: str) -> DataFrame:
    """Give the i-th customer row the i-th distinct id of the transactions.

    Ids are ordered by first appearance (smallest ``seen_by``).
    """
    ids = transactions.groupBy("customer_id").agg(F.min(seen_by).alias("_seen"))
    numbered = with_row_index(ids, [F.col("_seen"), F.col("customer_id")], "_position")
    rows = with_row_index(customers, order_by, "_position")
    return rows.join(numbered.select("_position", "customer_id"), "_position", "left").drop("_position")


def dates_by_position(df: DataFrame, order_by: list, start: str = "2020-01-01") -> DataFrame:
    """Absent date: consecutive days from ``start`` along ``order_by``."""
    if "date" in df.columns:
        return df
    out = with_row_index(df, order_by, "_position")
    day = F.date_add(F.lit(start).cast("date"), F.col("_position").cast("int"))
    return out.withColumn("date", day.cast("timestamp_ntz")).drop("_position")


def amount_from_first_number(df: DataFrame) -> DataFrame:
    """Absent amount: the first numeric column."""
    if "amount" in df.columns:
        return df
    first = next((f.name for f in df.schema.fields if is_numeric(f.dataType)), None)
    if first is None:
        raise ValueError("no numeric column can stand in for the amount")
    return df.withColumn("amount", F.col(first))


def split_wide(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One wide table -> (customers, transactions, merged).

    Customers keep the first value of each customer column along ``order_by``.
    """
    facts = [c for c in ("transaction_id", "customer_id", "date", "amount", "category") if c in df.columns]
    about = [c for c in ("customer_name", "age", "gender", "location", "country") if c in df.columns]
    first = F.min_by(F.struct(*about), F.struct(*order_by)).alias("_c")
    customers = (
        df.where("customer_id is not null").groupBy("customer_id").agg(first).select("customer_id", "_c.*")
    )
    transactions = df.select(*facts)
    return customers, transactions, join_one(transactions, customers, how="left")


def stamp_run(df: DataFrame, user_id: str, analysis_id=None) -> DataFrame:
    """Tenant and run key on every row; a given or present run key is kept."""
    out = df.withColumn("user_id", F.lit(user_id))
    if analysis_id is not None:
        return out.withColumn("analysis_id", F.lit(analysis_id))
    return out if "analysis_id" in df.columns else out.withColumn("analysis_id", F.lit(str(uuid.uuid4())))


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Project to the wanted columns that exist."""
    return df.select([c for c in wanted if c in df.columns])


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def report_columns(df: DataFrame) -> DataFrame:
    """Make sure the report columns exist and hold no nulls."""
    new = {}
    for c in REPORT_TEXTS:
        new[c] = F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) if c in df.columns else F.lit("Unknown")
    for c in REPORT_NUMBERS:
        new[c] = F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)
    return df.withColumns(new)


def prefer_final_probability(df: DataFrame) -> DataFrame:
    if "churn_probability_final" not in df.columns:
        return df
    return df.withColumn("churn_probability", F.col("churn_probability_final"))


def parse_date_columns(df: DataFrame) -> DataFrame:
    """Convert columns that are named like dates; numeric columns never."""
    new = {}
    for f in df.schema.fields:
        textual = isinstance(f.dataType, T.StringType) or is_temporal(f.dataType)
        if textual and _has(f.name.lower(), DATE_NAME_PARTS):
            new[f.name] = parse_instant(F.col(f.name), f.dataType)
    return df.withColumns(new) if new else df


def currency_sign(df: DataFrame, order_by: str | None = None) -> str:
    """First currency sign in a column name, else in the first 20 amounts, else ``$``."""
    for name in df.columns:
        for sign in CURRENCY_SIGNS:
            if sign in name:
                return sign
    if "amount" in df.columns:
        amounts = df.orderBy(order_by) if order_by else df
        for (text,) in amounts.select(F.col("amount").cast("string")).limit(20).collect():
            for sign in CURRENCY_SIGNS:
                if text and sign in text:
                    return sign
    return "$"


def is_complete(df: DataFrame, required: list[str] = COMPLETENESS_COLUMNS) -> bool:
    """False when a required column is missing or holds only nulls."""
    if not set(required) <= set(df.columns):
        return False
    return all(scalars(df, **{c: F.count(c) for c in required}).values())


def completeness(df: DataFrame, required: list[str] = COMPLETENESS_COLUMNS) -> DataFrame:
    """The same gate as a one-row report."""
    absent = [c for c in required if c not in df.columns]
    counts = [(F.count(c) if c not in absent else F.lit(0)).alias(f"{c}_rows") for c in required]
    row = df.agg(*counts)
    ok = F.lit(not absent)
    for c in required:
        ok = ok & (F.col(f"{c}_rows") > 0)
    return row.withColumn("complete", ok)
