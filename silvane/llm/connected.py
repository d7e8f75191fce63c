"""Connected components by alternating large and small stars, on DataFrames.

Each step groups edges by node and keeps minima, so nothing but the edges themselves is held: a node of
any degree is only summed over. Minima are joined back to the edges as plain shuffles on both sides, of
which Spark splits the edges of a node that has many. The number of steps grows with the logarithm of
the graph; the way is the same for a graph of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for every node of the edges ``a``, ``b`` (128-bit keys).

    Loops are allowed, and tie a node to nothing; an edge may come in either direction and more than once.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = common.cut(edges.where(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v")).distinct())
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        now = common.cut(_small(_large(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(common.hidden(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    told = least.select(common.hidden(F.col("u")).alias("u"), "m")
    tied = edges.join(told, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
