"""Forests cut back to a minimum split size.

Spark grows trees with a least number of rows per child, but has no limit on
the rows of a node that is split. A grown tree is cut back instead: its nodes are
a table, a node of fewer rows than the limit becomes a leaf, with the statistics
it already holds, and what lay below it goes. Rows can only get fewer on the
way down, so a node goes exactly if its parent is below the limit: one join,
however deep the tree. One fit thus serves every split size of a grid.

Rows of a node are counted as the bootstrap drew them, with repetitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patronage.operators.grown_forest import GrownForest
from patronage.session import copy_path, delete_path, scratch_path

#: What a leaf holds in place of a split.
LEAF = {"gain": "-1.0D", "leftChild": "-1", "rightChild": "-1"}
NO_SPLIT = "named_struct('featureIndex', -1, 'leftCategoriesOrThreshold', cast(array() as array<double>), 'numCategories', -1)"


def cut_nodes(nodes: DataFrame, least: int) -> DataFrame:
    """Node table (``treeID``, ``nodeData`` as stored) without what lies below nodes of fewer than ``least`` rows.

    Numbers of the nodes are consecutive again, in their old order.
    """
    flat = nodes.select("treeID", "nodeData.*")
    small = flat.where((F.col("rawCount") < least) & (F.col("leftChild") >= 0))
    gone = small.select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id"))
    order = Window.partitionBy("treeID").orderBy("id")  # one tree: bounded by the rows that are fitted
    kept = flat.join(gone, ["treeID", "id"], "left_anti").withColumn("new", F.row_number().over(order) - 1)
    closed = F.col("rawCount") < least

    def child(side: str) -> Column:
        return F.when(~closed & (F.col(side) >= 0), F.col(f"{side}New")).otherwise(F.expr(LEAF[side]))

    numbers = kept.select("treeID", "id", "new")
    for side in ("leftChild", "rightChild"):
        kept = kept.join(numbers.select("treeID", F.col("id").alias(side), F.col("new").alias(f"{side}New")), ["treeID", side], "left")
    data = F.struct(
        F.col("new").alias("id"), "prediction", "impurity", "impurityStats", "rawCount",
        F.when(closed, F.expr(LEAF["gain"])).otherwise(F.col("gain")).alias("gain"),
        child("leftChild").alias("leftChild"), child("rightChild").alias("rightChild"),
        F.when(closed, F.expr(NO_SPLIT)).otherwise(F.col("split")).alias("split"),
    )
    return kept.select("treeID", data.alias("nodeData"))


def cut_back(model, least: int):
    """The forest as if nodes of fewer than ``least`` rows had not been split; the model itself for ``least`` up to 2."""
    if least <= 2:
        return model
    if isinstance(model, GrownForest):
        return model.cut_back(least)
    spark = SparkSession.active()
    grown, cut = scratch_path(spark, "grown"), scratch_path(spark, "cut")
    model.write().save(grown)
    nodes = spark.read.parquet(f"{grown}/data")
    cut_nodes(nodes, least).coalesce(1).write.parquet(f"{cut}/data")
    for part in ("metadata", "treesMetadata"):
        copy_path(spark, f"{grown}/{part}", f"{cut}/{part}")
    out = type(model).load(cut)
    for path in (grown, cut):
        delete_path(spark, path)
    return out

