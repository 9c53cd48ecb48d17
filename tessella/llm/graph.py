"""Connected components of a large sparse graph, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that is reachable.

    Large-star and small-star steps alternate until no edge changes. Each step is one aggregate (the
    smallest neighbour of each node, combined before the shuffle) and one join. The edges of a node with very
    many neighbours meet in one task of that join, as pairs of numbers that stream past one row, never as a
    list; adaptive execution splits such a task by its size. Every round is written to the shared folder. Nulls,
    loops and repeated edges are allowed and change nothing; no edges give no rows.
    """
    current = materialize(_tidy(edges.where("a is not null and b is not null and a != b")), "edges")
    while True:
        large = _star(current, small=False)
        after = materialize(_star(large, small=True), "edges")
        changed = after.join(current, ["a", "b"], "left_anti").limit(1).count() + current.join(after, ["a", "b"], "left_anti").limit(1).count()
        current = after
        if not changed:
            break
    # Now every edge goes from a node to its root.
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node a to the smaller b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the larger (or, for small, the smaller) neighbours of each node to its smallest neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if small:
        new = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        new = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node whose larger neighbours are linked to itself keeps those edges; a node with a smaller
        # neighbour is reached from that neighbour's own star
    return _tidy(new.where("a != b"))
