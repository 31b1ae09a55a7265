"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi join whose other side has one row a node, so
a node with very many neighbours can be split. The published bound is O(log^2) rounds, so long chains of redirects end soon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curatorium.session import cut_lineage

LINKS_PER_TASK, LEAST_TASKS = 50_000, 8


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.union(least.select("a", F.col("_m").alias("b"))).distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether all links lead straight to a node that leads nowhere itself."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("leaves"), F.lit(0).alias("enters")).union(
        stars.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.max("enters").alias("enters"))
    return seen.where((F.col("leaves") > 1) | ((F.col("leaves") > 0) & (F.col("enters") > 0))).isEmpty()


def _fewer(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks, each with files of its own in every shuffle of a round, than so many links need."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // LINKS_PER_TASK)))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any ordered type -> (node, component), component being the smallest node reached. Nodes without a link
    have no row; loops, nulls and repeated links change nothing."""
    stars = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = stars.count()
    while not _settled(stars):
        stars = cut_lineage(_fewer(_small_star(_fewer(_large_star(_fewer(stars, rows)), rows)), rows))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
