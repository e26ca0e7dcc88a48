"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): the smallest node that links reach.

    Each round gives a node the smallest label among itself and its neighbours, then the label of that label, until
    nothing changes; with the second step, the rounds grow as the logarithm of the longest chain. Sums of hot nodes
    are formed before the shuffle. Each round is written, so lost executors repeat one round at most.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    nodes = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "nodes")
    while True:
        near = both.join(nodes.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = nodes.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = low.join(nodes.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left")
        now = stored(jump.select("node", F.least("comp", F.coalesce("far", "comp")).alias("comp"), "old"), "nodes")
        if now.where("comp != old").isEmpty():
            return now.select("node", "comp")
        nodes = now.select("node", "comp")
