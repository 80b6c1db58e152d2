"""Connected components of a table of links, in rounds of minimum hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heldout.functions.materialize import materialize


def roots(parents: DataFrame) -> DataFrame:
    """(node, label) with every chain of (node, label) followed to its end; labels are smaller than their nodes."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        moved = materialize(parents.join(up, "label", "left").select("node", F.coalesce("_next", "label").alias("label"), F.col("_next").isNotNull().alias("_moved")))
        parents = moved.select("node", "label")
        if moved.filter("_moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node that it reaches.

    Each round hangs every node below its smallest neighbour, follows the
    chains, and contracts the links to the roots; only links between different
    roots go on, so a few rounds suffice for any shape.  Group aggregates are
    partial first and nothing is gathered per component.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while not edges.isEmpty():
        parents = roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
        if known is None:
            known = parents
        else:
            up = parents.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            known = known.join(up, "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
            known = materialize(known.unionByName(parents))
        left = parents.select(F.col("node").alias("a"), F.col("label").alias("_a"))
        right = parents.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        edges = materialize(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if known is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return known.groupBy("node").agg(F.min("label").alias("label"))
