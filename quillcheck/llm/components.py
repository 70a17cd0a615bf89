"""Connected components by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("node"), F.col("m").alias("to")).where("node <> to").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them; edges point from node to a smaller one."""
    least = edges.groupBy("node").agg(F.min("to").alias("m"))
    moved = edges.join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).where("node <> to")
    return moved.union(least.select("node", F.col("m").alias("to"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), a < b: root is the smallest node of the component.

    Rounds end when no edge moves, which takes a number of rounds that grows with the logarithm of the
    longest chain. No task needs all neighbours of a node at once: minima are combined before the
    shuffle, and the joins back on a hub have one row for it on one side.
    """
    now = written(edges.select("a", "b"), "components")
    mark = None
    while True:
        now = written(_small_star(_large_star(now)), "components")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            return now.select("node", F.col("to").alias("root"))
        mark = new
        now = now.select(F.col("to").alias("a"), F.col("node").alias("b"))
