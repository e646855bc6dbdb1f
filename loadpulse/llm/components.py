"""Connected components of a graph by contraction, all in DataFrames.

In every round each node hooks onto its smallest neighbour, chains of hooks are
shortened by jumping until each node knows its root, and edges are renamed to roots;
edges inside a root go.  Each round at least halves the nodes that still have edges.
Steps are stored, so a lost executor costs one step, and joins read plain tables, so
adaptive execution can split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _roots(edges: DataFrame) -> tuple[DataFrame, str]:
    """``node, component``: the root of each node after hooking and jumping."""
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    roots, at = common.stored(
        hooks.select("node", F.least("node", "b").alias("component")), "roots")
    while True:
        above = roots.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped, next_at = common.stored(roots.join(above, "component").select(
            "node", F.col("up").alias("component"), (F.col("up") != F.col("component")).alias("moved")),
            "roots")
        common.discard(spark, at)
        roots, at = jumped.select("node", "component"), next_at
        if jumped.where("moved").isEmpty():
            return roots, at


def _renamed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    a = roots.select(F.col("node").alias("a"), F.col("component").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("component").alias("rb"))
    return (
        edges.join(a, "a").join(b, "b").where("ra <> rb")
        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; a component's name is
    its smallest node.  No edges give no rows."""
    spark = edges.sparkSession
    labels, labels_at = None, None
    left, left_at = common.stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    kind = left.schema["a"].dataType.simpleString()
    while not left.isEmpty():
        roots, roots_at = _roots(left)
        fewer, fewer_at = common.stored(_renamed(left, roots), "edges")
        if labels is None:
            labels, labels_at = roots, roots_at
        else:
            renames = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
            joined, joined_at = common.stored(
                labels.join(renames, "component", "left")
                .select("node", F.coalesce("root", "component").alias("component")), "labels")
            common.discard(spark, labels_at, roots_at)
            labels, labels_at = joined, joined_at
        common.discard(spark, left_at)
        left, left_at = fewer, fewer_at
    common.discard(spark, left_at)
    if labels is None:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    return labels
