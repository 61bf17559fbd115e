"""The session that the command line, the server and the benchmark use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. On one machine shuffle partitions follow its cores; on a cluster
    shuffles start with many small partitions, which adaptive execution merges to the advised size."""
    cores = os.cpu_count() or 4
    b = SparkSession.builder.appName("weftgraph")
    master = master or os.environ.get("SPARK_MASTER") or f"local[{cores}]"
    own = {"spark.sql.shuffle.partitions": str(cores)} if master.startswith("local") else {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m"}
    b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | own | conf).getOrCreate()
