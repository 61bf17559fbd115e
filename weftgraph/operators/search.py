"""Vector search: exact cosine, best vector of each node, collections merged after their own top k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

DIGITS = 4


def scores(vectors: DataFrame, query: list[float], *also: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", "node_id", *also, F.round(cosine(F.col("embedding"), q), DIGITS).alias("score"))
    return scored.where("score is not null")


def search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k best rows of vectors (vec_id, node_id, embedding), by rounded score, then vec_id."""
    return scores(vectors, query).orderBy(F.desc("score"), "vec_id").limit(k)


def search_all(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Top k of each collection, then each node's best, then top k of those."""
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("score"), "vec_id"))  # k rows a task go on
    parts = scores(vectors, query, "collection").withColumn("place", place).where(F.col("place") <= k).drop("place", "collection")
    best = parts.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "vec_id"))).where("r = 1").drop("r")
    return best.orderBy(F.desc("score"), "node_id").limit(k)
