"""Connected components of a graph that is far larger than one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches: ``node, component`` for every node with an edge.

    ``edges`` has two columns of node ids. Large-star and small-star steps take turns: each links a node's
    neighbours to the smallest of them, until only stars are left, which takes about log(n) rounds. The smallest
    neighbour is reduced map-side, so a node with a third of all edges is no task of its own; joining it back is a
    shuffled join, whose large partitions adaptive execution splits. Each round is a table in the shared folder.
    """
    left, right = edges.columns
    down = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    down = stored(down.filter("u > v").distinct(), "stars")
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above u go to the smallest neighbour.
        large = down.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u")
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        # Small star: neighbours below u, and u itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        down = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        centres = down.select(F.col("v").alias("u")).distinct()
        if down.join(centres, "u", "left_semi").isEmpty() and down.count() == down.select("u").distinct().count():
            return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                centres.select(F.col("u").alias("node"), F.col("u").alias("component"))
            )
