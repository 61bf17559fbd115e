"""Upserts of a stream of changes into a keyed table, batch by batch.

A table is BUCKETS folders by a hash of the key. A batch is reduced to its last change per key and reconciled
with the buckets that its keys fall into; only these are written anew. A manifest then gains one file, which
names the batch and the new folders, so a reader sees all of a batch or nothing of it. Batches are numbered,
and a number already applied is skipped, so a batch that is delivered again changes nothing. vacuum() deletes
what no reader of the present state needs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
MANIFEST = "batch long, bucket int, at string, schema string"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _manifest(self) -> list:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/applied").collect()  # BUCKETS rows a batch at most
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    @staticmethod
    def _state(manifest: list) -> dict[int, str | None]:
        """Each bucket's folder: that of the last batch that wrote it."""
        return {r.bucket: r.at for r in sorted(manifest, key=lambda r: r.batch) if r.bucket is not None}

    def _load(self, manifest: list, only: set[int] | None = None) -> DataFrame | None:
        if not manifest:
            return None
        schema = T.StructType.fromJson(json.loads(max(manifest, key=lambda r: r.batch).schema))
        paths = [f"{self.path}/{at}" for b, at in sorted(self._state(manifest).items()) if at and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        return self._load(self._manifest())

    def apply(self, batch: DataFrame, number: int) -> None:
        """The batch's last row per key (by order) wins; rows with deleted = true remove their key."""
        manifest = self._manifest()
        if number in {r.batch for r in manifest}:
            return
        cols = [c for c in batch.columns if c not in (self.key, "deleted")]
        last = batch.groupBy(self.key).agg(F.max_by(F.struct(*cols, "deleted"), self.order).alias("new"))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = {r.b for r in last.select(bucket.alias("b")).distinct().collect()}  # BUCKETS at most
        now = self._load(manifest, touched)
        if now is None:
            out = last.where("not coalesce(new.deleted, false)").select(self.key, *[F.col(f"new.{c}").alias(c) for c in cols])
        else:
            both = now.select(self.key, F.struct(*cols).alias("old")).join(last, self.key, "full_outer")
            late = F.col("new").isNull() | (F.col(f"new.{self.order}") < F.col(f"old.{self.order}"))
            both = both.withColumn("keep_old", F.coalesce(late, F.lit(False))).where("keep_old or not coalesce(new.deleted, false)")
            out = both.select(self.key, *[F.when(F.col("keep_old"), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in cols])
        at = f"v{number}-{uuid.uuid4().hex}"
        out.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{at}")
        schema = out.schema.json()
        written = self.spark.read.schema(T.StructType([*out.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{at}")
        full = {r.bucket for r in written.select("bucket").distinct().collect()}
        rows = [(number, b, f"{at}/bucket={b}" if b in full else None, schema) for b in sorted(touched)] or [(number, None, None, schema)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/applied")

    def vacuum(self) -> int:
        """Deletes folders that the present state doesn't name; how many. For when no one reads an older state."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        needed = {a for a in self._state(self._manifest()).values() if a}
        gone = 0
        for version in store.listStatus(at):
            name = version.getPath().getName()
            if not name.startswith("v"):
                continue
            for part in store.listStatus(version.getPath()):
                of = part.getPath().getName()
                if of.startswith("bucket=") and f"{name}/{of}" not in needed:
                    gone += bool(store.delete(part.getPath(), True))
        return gone

    def start(self, changes: DataFrame, checkpoint: str):
        """Runs until all that is available has been applied."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emit_counts(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events per type and time window, with a watermark: a stream's or a table's."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
