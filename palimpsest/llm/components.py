"""Connected components by alternating large and small stars; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

# After some rounds all edges of a component hang on its root. Minima are combined before their shuffle, and written, so that
# the join that brings them to the edges has plain tables on both sides: adaptive execution splits a root's edges.


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node with the smallest of the node and its neighbours; u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    out = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
    discard(least)
    return out


def _small_star(down: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of these."""
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(others.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    discard(least)
    return out


def _done(stars: DataFrame) -> bool:
    """Whether every node has one root, and no root has another."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes that have an edge to another.

    ``edges``: (u, v) of one orderable type. The rounds grow with the logarithm of the longest path.
    """
    stars, before = edges.select("u", "v").where("u <> v"), None
    while before is None or not _done(stars):
        large = _large_star(stars)
        before, stars = stars, _small_star(large)
        discard(large, *([before] if hasattr(before, "scratch_path") else []))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
