"""Connected components of a table of links, by joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquest.session import materialize


def _flattened(tree: DataFrame) -> DataFrame:
    """Lead each node to the end of its way of roots, in steps that double."""
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = materialize(tree.join(up, "root").select(
            "node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots")
        tree = moved.select("node", "root")
        if moved.filter("moved").isEmpty():
            return tree


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` of links ``a, b``: the smallest node reached; only nodes with links.

    A round leads each node to its smallest neighbour, if that is smaller, and on
    to the end of that way, and then draws the links between those ends, without
    repeats. A component at least halves its ends in a round, and links shrink with
    them. Tables are written after each step; the driver learns only whether
    anything is left.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = materialize(links.filter("a != b").select(*ends).distinct(), "links")
    roots = materialize(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).filter(
        F.lit(False)), "roots")
    first = True
    while not edges.isEmpty():
        near = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        # Nodes that are the smaller end of each of their links are roots.
        own = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
        tree = _flattened(materialize(near.unionByName(own).groupBy("node").agg(
            F.min("root").alias("root")), "roots"))
        if first:
            roots, first = tree, False
        else:
            later = tree.select(F.col("node").alias("root"), F.col("root").alias("later"))
            roots = materialize(roots.join(later, "root", "left").select(
                "node", F.coalesce("later", "root").alias("root")), "roots")
        ra, rb = (tree.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        drawn = edges.join(ra, "a").join(rb, "b").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = materialize(drawn.filter("a != b").distinct(), "links")
    return roots
