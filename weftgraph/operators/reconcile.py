"""Upserts that keep what was added by hand, and replacement of edge sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(current: DataFrame, desired: DataFrame, key: str, preserve: list[str]) -> DataFrame:
    """All keys of both with what happens to each: created, updated, unchanged or deleted. Columns come from
    desired, those to preserve from current."""
    cols = [c for c in desired.columns if c != key and c not in preserve]
    a = current.select(F.col(key), F.struct(*[c for c in current.columns if c in cols or c in preserve]).alias("old"))
    b = desired.select(F.col(key), F.struct(*cols).alias("new"))
    both = a.join(b, key, "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    action = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return both.select(key, action.alias("action"), *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in cols], *[F.col(f"old.{c}").alias(c) for c in preserve])


def applied(plan: DataFrame) -> DataFrame:
    """The table after the plan."""
    return plan.where("action <> 'deleted'").drop("action")


def orphans(plan: DataFrame, key: str) -> DataFrame:
    return plan.where("action = 'deleted'").select(key)


def replace_edges(edges: DataFrame, new: DataFrame, type_: str) -> DataFrame:
    """edges with all of one type replaced."""
    return edges.where(F.col("type") != type_).unionByName(new.withColumn("type", F.lit(type_)).select(*edges.columns))


def edge_gap(wanted: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """How many edges were wanted, and how many have both ends (source_id, target_id against id)."""
    ok = wanted.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return wanted.agg(F.count(F.lit(1)).alias("wanted")).withColumn("k", F.lit(1)).join(ok.agg(F.count(F.lit(1)).alias("made")).withColumn("k", F.lit(1)), "k").select("wanted", "made", (F.col("wanted") - F.col("made")).alias("gap"))


def without_orphans(vectors: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Vectors without those of deleted keys; no collection is dropped."""
    return vectors.join(deleted.select(key), key, "left_anti")
