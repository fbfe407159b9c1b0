"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _large_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.stage(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = common.stage(spark, down.groupBy("u").agg(F.min("v").alias("m")), "least")
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one v only, which is no u itself."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("u").alias("x"))
    hung = edges.select(F.col("v").alias("x")).distinct().join(edges.select(F.col("u").alias("x")), "x", "left_semi")
    return twice.unionByName(hung).isEmpty()


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root): each node that has an edge, except the roots, with its component's least node.

    Every step is written to the shared folder, which cuts lineage. The minimum of a hub's neighbours is a
    partial aggregate, staged before it is joined: both sides of that join are plain shuffles then (or the small
    one is broadcast), so the adaptive skew join splits a hub's edges over tasks. Rounds grow with the logarithm of
    the longest chain. They keep components together and end once each node hangs from one root and no root from another.
    """
    links = common.stage(spark, edges, "edges")
    edges = common.stage(spark, _small_star(spark, links), "star")
    common.forget(spark, links)
    while not _are_stars(edges):
        large = common.stage(spark, _large_star(spark, edges), "star")
        common.forget(spark, edges)
        edges = common.stage(spark, _small_star(spark, large), "star")
        common.forget(spark, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
