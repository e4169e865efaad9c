"""Connected components by hooking, pointer jumping and contraction, all in joins and aggregates.

Every node hooks to its smallest smaller neighbour, pointer jumping makes the trees flat in a
logarithmic number of joins, and the edges are drawn anew between the roots. Each round leaves at most
half of the nodes. Roots of many nodes are plain skewed join keys: Spark splits or broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't the smallest of its component."""
    edges = scratch.save(_oriented(edges), "edges")
    labels = None
    while not edges.isEmpty():
        tree = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "tree")
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
            tree = scratch.save(tree.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "tree")
            if tree.where("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.drop("moved")
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if labels is None:
            labels = tree
        else:
            labels = labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(tree)
            labels = scratch.save(labels, "labels")
        to = lambda c: tree.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        edges = scratch.save(_oriented(moved.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
