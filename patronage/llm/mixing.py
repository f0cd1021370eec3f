"""Mixing sources to target weights: capped water-filling and seeded repetition.

Sizes are words. A source's target is its weight's share of the wanted total,
held at ``max_epochs`` times its size; what that frees goes to the other
sources by weight, until none is above its limit. A source then gives whole
repetitions of all its documents, and the rest of its target as one more
repetition of the documents that come first in a seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.common import WORD, fresh, set_aside, total
from patronage.operators.selection import with_row_index
from patronage.session import materialize

#: The seeded order is a 52-bit number; a source's histogram over it has 2^16 bins.
BIN_BITS = 36


def seeded_place(seed: int, key: Column, text: Column) -> Column:
    """A number below 2^52 by hash of seed, document number and text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...], source: str = "source") -> DataFrame:
    """Add ``weight``: the given weights in turn over the sources by code point, null last."""
    listed = with_row_index(sources, [F.col(source).asc_nulls_last()], "_at")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return listed.withColumn("weight", F.get(turn, (F.col("_at") % len(weights)).cast("int"))).drop("_at")


def water_fill(sources: DataFrame, wanted: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``source_size`` and ``weight``.

    Each round fixes the sources that are above their limit and shares what
    is left among the others; only two sums come to the driver. If all limits
    together are below ``wanted``, every source stands at its limit.
    """
    limit = F.col("source_size") * F.lit(max_epochs)
    level, fixed = None, -1
    while True:
        at_limit = F.lit(False) if level is None else limit <= F.lit(level) * F.col("weight")
        t = total(
            sources, n=F.count_if(at_limit), held=F.sum(F.when(at_limit, limit)), weight=F.sum(F.when(~at_limit, F.col("weight")))
        )
        if t["n"] == fixed or not t["weight"]:
            break
        fixed, level = t["n"], (wanted - (t["held"] or 0.0)) / t["weight"]
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.when(limit <= F.lit(level) * F.col("weight"), limit).otherwise(F.lit(level) * F.col("weight")))


def _cuts(items: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the place of the seeded order in which its one more repetition ends: ``_cross``.

    Rows are taken while the middle of their words is not beyond the words
    still wanted: all of the places before, and the first ``_most`` of the
    ``_tied`` rows of that place. A histogram finds the bin that holds it, and
    only that bin's rows are ordered.
    """
    bins = items.groupBy("_source", F.shiftright("_place", BIN_BITS).alias("_bin")).agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("_source").orderBy("_bin")
    bins = bins.withColumn("_end", F.sum("_words").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    plan = plan.select(F.col("_source").alias("_s"), "extra")
    same = F.col("_source").eqNullSafe(F.col("_s"))
    crossed = bins.join(plan, same).where("_end > extra").groupBy("_source").agg(
        F.min_by(F.struct("_bin", (F.col("_end") - F.col("_words")).alias("before"), "extra"), "_bin").alias("x")
    )
    crossed = crossed.select(
        F.col("_source").alias("_s"), F.col("x._bin").alias("_b"), F.col("x.before").alias("before"), F.col("x.extra").alias("extra")
    )
    near = items.join(crossed, same & (F.shiftright("_place", BIN_BITS) == F.col("_b"))).groupBy("_source", "_place").agg(
        F.sum("size").alias("w"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("extra").alias("extra")
    )
    order = Window.partitionBy("_source").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("end", F.col("before") + F.sum("w").over(order)).where("end > extra")
    first = near.groupBy(F.col("_source").alias("_s")).agg(F.min_by(F.struct("_place", "w", "n", "end", "extra"), "_place").alias("x")).select("_s", "x.*")
    left = F.col("extra") - (F.col("end") - F.col("w"))
    most = F.least(F.col("n"), F.floor(left / (F.col("w") / F.col("n")) + 0.5))
    return first.select("_s", F.col("_place").alias("_cross"), most.cast("long").alias("_most"), F.col("n").alias("_tied"))


def _counted_ties(rows: DataFrame) -> DataFrame:
    """``_turn`` from 0 among the rows of a source, which stand at one place.

    The rows are written with the number that their reading gave them, and
    are counted along it range by range, so equal rows may fill many tasks.
    """
    stage = materialize(rows.withColumnRenamed("_place", "_spot").withColumn("_row", F.monotonically_increasing_id()), "mix-ties")
    listed = with_row_index(stage, [F.col("_source"), F.col("_row")], "_at")
    first = listed.groupBy(F.col("_source").alias("_t")).agg(F.min("_at").alias("_first"))
    joined = listed.join(first, F.col("_source").eqNullSafe(F.col("_t")))
    return joined.withColumn("_turn", F.col("_at") - F.col("_first")).drop("_row", "_at", "_t", "_first").withColumnRenamed("_spot", "_place")


OUTPUTS = ("size", "source_size", "target", "repeats", "taken")


def mix(
    docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float = 2.0, seed: int = 17,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``repeats`` and ``taken``; columns of these names are replaced.

    ``share`` times all words is shared among the sources; the weights go to
    sources by code point in turn, null being the last source. A null or blank
    text has size 0 and is never taken. Rows that share a number and text share
    a place of the order and are counted there: the wanted part of them is
    taken, so that also a source of one repeated row comes within one document
    of its target. Reruns agree; an empty table gives an empty one. Other
    columns pass through, whatever their names. ``expand`` repeats the rows.
    """
    inner, restore = set_aside(docs, [key, text, source], OUTPUTS)
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sized = inner.withColumns({"size": words, "_place": seeded_place(seed, F.col(key), F.col(text))})
    items = materialize(sized.select(F.col(source).alias("_source"), "_place", "size"), "mix-items")
    sources = materialize(items.groupBy("_source").agg(F.sum("size").alias("source_size")), "mix-sources")
    sources = materialize(cycled_weights(sources, weights, "_source"), "mix-weights")
    wanted = share * (total(sources, n=F.sum("source_size"))["n"] or 0)
    plan = water_fill(sources, wanted, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = materialize(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    cuts = _cuts(items, plan.where("extra > 0"))
    plan = materialize(plan.join(cuts, plan["_source"].eqNullSafe(cuts["_s"]), "left").drop("_s", "extra", "weight"), "mix-plan")
    plan = plan.withColumnRenamed("whole", "_whole")
    out = sized.join(plan, sized[source].eqNullSafe(plan["_source"]), "left").withColumn("_turn", F.lit(0).cast("long"))
    if not plan.where("_tied > 1").isEmpty():
        tied = F.coalesce((F.col("_place") == F.col("_cross")) & (F.col("_tied") > 1), F.lit(False))
        out = out.where(~tied).unionByName(_counted_ties(out.where(tied).drop("_turn")))
    taken = (F.col("_place") < F.col("_cross")) | (F.col("_place") == F.col("_cross")) & (F.col("_turn") < F.col("_most"))
    more = F.coalesce(taken, F.lit(False)).cast("long")
    out = out.withColumn("repeats", F.when(F.col("size") > 0, F.col("_whole") + more).otherwise(0).cast("long"))
    return restore(out.withColumn("taken", F.col("repeats") * F.col("size")))


def expand(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as often as it repeats."""
    copy = fresh("copy", mixed)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))
    return mixed.where("repeats > 0").withColumn(copy, copies).drop(copy)
