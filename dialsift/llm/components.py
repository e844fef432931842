"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise


def _smallest(pairs: DataFrame, most: int) -> DataFrame:
    """Each of the at most ``most`` pairs (u, v) with the smallest of u and its partners. The hub of a giant
    component has most of the pairs."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return hot_join(pairs, low, ["u"], most)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    return _smallest(both, most).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` go from the larger node u to the smaller v."""
    pairs = _smallest(edges, most)
    return pairs.select("u", F.col("m").alias("v")).union(pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its
    component, a root being its own. Each round is written to the shared folder; the rounds
    grow with the logarithm of the component size. Only a count and a checksum reach the driver."""
    forest = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = forest.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both_ways = 2 * now[0]
        stars = materialise(_large_star(forest, both_ways), "stars")
        forest = materialise(_small_star(stars, both_ways), "edges")
    return forest.select(F.col("u").alias("node"), F.col("v").alias("root")).union(forest.select("v", "v").distinct())
