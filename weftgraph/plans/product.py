"""Joins whose result is a product within each key: as large as it has to be, but spread, and never shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a key that one task makes.
PAIRS = 20_000_000
#: Tasks at most, if keys have more pairs than PAIRS.
TASKS = 4096


def paired(left: DataFrame, right: DataFrame, key: list[str], deal: str, keep: Callable[[DataFrame, str], DataFrame], pairs: int = PAIRS) -> DataFrame:
    """left joined with right on key. The left rows of a key with more than ``pairs`` pairs are dealt by ``deal`` to
    blocks of about so many, each with a copy of the key's right rows; so rows shuffled grow with both sides, not with
    the result, and no task makes the pairs of a hot key alone."""
    left, right = keep(left, "pairs-left"), keep(right, "pairs-right")
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    blocks = F.least(F.ceil(F.col("l").cast("double") * F.col("r") / pairs), F.col("l")).cast("int")
    hot = keep(count(left, "l").join(count(right, "r"), key).select(*key, blocks.alias("blocks")).where("blocks > 1"), "pairs-hot")
    dealt = hot.agg(F.sum("blocks")).first()[0]
    if not dealt:
        return left.join(right, key)
    n = min(dealt + int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS)
    many = F.coalesce("blocks", F.lit(1))
    left = left.join(hot, key, "left").withColumn("block", F.pmod(F.xxhash64(deal), many).cast("int")).drop("blocks")
    right = right.join(hot, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), many - 1))).drop("blocks")
    by = [*key, "block"]
    return left.repartition(n, *by).join(right.repartition(n, *by), by).drop("block")
