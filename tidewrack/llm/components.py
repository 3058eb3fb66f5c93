"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import forget, materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b.

    Large: every node links its larger neighbours to the least of itself and all its neighbours. Small: every node links
    itself and its smaller neighbours to the least of these. Minima are partially aggregated, and edges are joined with
    them, so no neighbourhood is ever collected.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    least = least.select("a", F.least("a", "m").alias("m"))
    if large:
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most, and no node that has one is the end of another."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("n")).union(edges.select(F.col("b").alias("x"), F.lit(0).alias("n")).distinct())
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1 OR (n = 1 AND rows > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of the edges (a, b), the least ones included."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not _settled(now):
        wide = materialize(_star(now, large=True), "edges")
        new = materialize(_star(wide, large=False), "edges")
        forget(wide)
        forget(now)
        now = new
    release(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
