"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the ends of edges a, b.

    Each round is a few joins and counts on one node; hubs are pre-aggregated by min and
    their join can be split. Rounds grow with the logarithm of the longest chain, and each
    is cut off by a written table. They end when every node points to one centre alone and no
    centre points on: then each component is one star around its smallest node.
    """
    current = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        previous, current = current, materialize(_small_star(_large_star(current)), "edges")
        discard(previous)
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(current.select("b", F.lit(0), F.lit(1)))
        wrong = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out > 0 AND in > 0)")
        if not wrong.limit(1).count():
            break
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
