"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronage.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
#: The value that holds a caller's other columns; no operator has a column of such a name.
CARRIED = "carried columns"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def fresh(name: str, df: DataFrame, taken: Iterable[str] = ()) -> str:
    """``name``, lengthened until it is no column of ``df`` and none of ``taken``, in whatever case."""
    used = {c.lower() for c in [*df.columns, *taken]}
    while name.lower() in used:
        name += "_"
    return name


def set_aside(
    df: DataFrame, needed: Iterable[str], outputs: Iterable[str], carry: Iterable[str] | None = None
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The ``needed`` columns of ``df`` with all others in one value, and what gives them back.

    Whatever the caller's other columns are called, an operator that works on
    the first frame can name its own columns freely. The second, given the
    operator's result, returns the columns of ``df`` (those in ``carry``, if
    given) and then ``outputs``; columns of ``df`` named like an output, in
    whatever case, are replaced by it.
    """
    replaced = {c.lower() for c in outputs}
    used = list(dict.fromkeys(needed))
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in replaced]
    rest = [c for c in kept if c not in used]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    inner = df.select(*map(quoted, used), *([F.struct(*map(quoted, rest)).alias(CARRIED)] if rest else []))

    def restore(out: DataFrame) -> DataFrame:
        back = [quoted(CARRIED).getField(c).alias(c) if c in rest else quoted(c) for c in kept]
        return out.select(*back, *outputs)

    return inner, restore


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def total(df: DataFrame, **aggregates: Column) -> dict:
    """Whole-table aggregates as plain numbers; one row reaches the driver."""
    return df.agg(*[c.alias(k) for k, c in aggregates.items()]).first().asDict()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component_id``: the smallest number reachable from each node of ``edges``.

    Rounds of two joins bring every node of a component to a star around its
    smallest number. A round hands each neighbour the smallest number near a
    node: a grouped minimum (combined before the shuffle) joined back to the
    edges, so no node's neighbours are gathered in one row. Every round is
    written to the shared folder. Nodes without an edge do not appear.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e = materialize(e.distinct(), "cc")
    seen = None
    while True:
        # Large star: every larger neighbour of u moves to the smallest number at u.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("low", "u").alias("low"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        e = materialize(e, "cc")
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = e.groupBy("u").agg(F.min("v").alias("low"))
        moved = e.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = materialize(moved.union(low.select("u", F.col("low").alias("v"))).distinct(), "cc")
        mark = total(e, n=F.count("*"), x=F.bit_xor(F.xxhash64("u", "v")))
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
        roots.select("node", F.col("node").alias("component_id"))
    )
