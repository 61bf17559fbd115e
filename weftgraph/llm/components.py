"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _pull(pairs: DataFrame) -> DataFrame:
    """Each a's neighbours b, beside the least of them and a itself."""
    return pairs.join(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")


def _is_star(edges: DataFrame) -> bool:
    """Whether each id points at one other at most, and those pointed at point at none."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not ends.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(id, group) of every id in links (a, b): group is the smallest id reachable. Ids may be any longs.
    Rounds grow with the logarithm of a component's size."""
    edges = stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-edges")
    while not _is_star(edges):
        large = _pull(_both(edges)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "components-edges")
        small = _pull(large)
        small = small.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(small, "components-edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("group")).union(edges.select("b", "b").distinct())
