"""Connected components of an edge table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): the rounds need
O(log^2 n) steps and every step is a group-by-min and a join. No edge or label leaves the
cluster; a node with very many neighbours costs one partial minimum per task, and the joins can
be split by adaptive execution. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked with the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars around smaller centres v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), (F.col("u") < F.col("v")).cast("int").alias("down"))
    centres = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    seen = ends.unionByName(centres).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down > 0)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest reachable node.

    ``edges`` has columns u, v (no nulls; loops and repeats are allowed).
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), name)
    while not _stars(edges):
        edges = stored(_small_star(_large_star(edges)), name)
    # the rounds keep what is connected, so a star's centre is its component's smallest node
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
