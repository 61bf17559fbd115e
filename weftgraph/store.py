"""Projects on disk: a folder per project. An import writes the tables that it changes and then adds one row to a
list of versions, which names the folder of every table; tables that an import doesn't change stay where they are.

Readers follow the last row, so they see all of an import or nothing of it. Uniqueness of ids takes the place
of constraints; partitions by kind and type take the place of indexes.
"""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as T
from .graph import Graph, endpoints
from .operators import enrichment as N
from .operators import texts as X
from .operators.reconcile import applied, orphans, reconcile, without_orphans
from .sources.documents import DEFAULT_NAMESPACES, read_flows, read_symbols

FLOW_KEYS = {"flows": "flow_id", "messages": "id", "events": "id", "http_clients": "id"}
PRESERVED = ["explanation", "explain_model"]


class ImportFailed(RuntimeError):
    """What was stored isn't what the document holds."""


class Project:
    def __init__(self, spark: SparkSession, root: str, name: str = "default"):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    # Versions: rows of a number and the folder of each table. A file with one row appears at once or not at all.

    def _current(self) -> tuple[int, dict[str, str]]:
        try:
            rows = self.spark.read.schema("version long, tables map<string, string>").json(f"{self.path}/versions").collect()
        except Exception as e:  # noqa: BLE001 - Spark says in the text that a path is missing
            if "PATH_NOT_FOUND" in str(e):
                return 0, {}
            raise
        last = max(rows, key=lambda r: r.version, default=None)
        return (last.version, dict(last.tables)) if last else (0, {})

    def _switch(self, at: str, written: list[str], keep: bool = True) -> None:
        """A version in which the tables written are in the folder at, and all others where they were."""
        number, tables = self._current()
        tables = (tables if keep else {}) | {n: f"{at}/{n}" for n in written}
        row = self.spark.createDataFrame([(number + 1, tables)], "version long, tables map<string, string>")
        row.coalesce(1).write.mode("append").json(f"{self.path}/versions")
        self.__dict__.pop("graph", None)

    def table(self, name: str) -> DataFrame | None:
        at = self._current()[1].get(name)
        return self.spark.read.parquet(f"{self.path}/{at}") if at else None

    def vacuum(self) -> int:
        """Deletes the folders that the last version doesn't name; how many. For when no one reads an older one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        needed = {at.split("/")[0] for at in self._current()[1].values()}
        own = self.graph.path.rsplit("/", 1)[-1] if "graph" in self.__dict__ else ""
        gone = 0
        for x in store.listStatus(path(self.path)):
            if x.isDirectory() and x.getPath().getName() not in {"versions", own, *needed}:
                gone += bool(store.delete(x.getPath(), True))
        return gone

    @cached_property
    def graph(self) -> Graph:
        nodes, edges = self.table("nodes"), self.table("edges")
        if nodes is None:
            nodes, edges = self.spark.createDataFrame([], T.NODES), self.spark.createDataFrame([], T.EDGES)
        g = Graph(self.spark, nodes, edges, f"{self.path}/derived-{uuid.uuid4().hex}")
        g.__dict__["nodes"], g.__dict__["edges"] = nodes, edges  # stored already
        return g

    def import_symbols(self, document: str, validate: bool = True) -> dict:
        """Replaces nodes and edges by a document's; flow tables stay. Returns counts by kind and type."""
        nodes, edges = read_symbols(self.spark, document)
        version = uuid.uuid4().hex
        at = f"{self.path}/{version}"
        nodes.sortWithinPartitions("kind", "fqn").write.parquet(f"{at}/nodes")
        stored = self.spark.read.parquet(f"{at}/nodes")
        endpoints(edges, stored).hint("rebalance", "type").write.partitionBy("type").parquet(f"{at}/edges")
        if validate:
            self._validate(nodes, edges, stored, self.spark.read.parquet(f"{at}/edges"))
        self._switch(version, ["nodes", "edges"])
        return self.counts()

    def _validate(self, nodes, edges, stored_nodes, stored_edges) -> None:
        want, got, keys = nodes.count(), stored_nodes.count(), stored_nodes.select("node_id").distinct().count()
        if want != got:
            raise ImportFailed(f"{want} nodes in the document, {got} stored")
        if keys != got:
            raise ImportFailed(f"{got - keys} nodes share an id with another")
        missing = edges.count() - stored_edges.count()
        if missing:
            raise ImportFailed(f"{missing} edges have an end that isn't a node")

    def counts(self) -> dict:
        g = self.graph
        by = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().orderBy(F.desc("count"), c).collect()}
        return {"nodes": by(g.nodes, "kind"), "edges": by(g.edges, "type")}

    def import_flows(self, document: str, namespaces: tuple[str, ...] = DEFAULT_NAMESPACES) -> dict:
        """Upserts the flow tables, deletes what the document lacks (and its vectors), replaces flow edges.
        Explanations survive. The same document twice changes nothing."""
        new = read_flows(self.spark, document, namespaces)
        version, report = uuid.uuid4().hex, {}
        at = f"{self.path}/{version}"
        deleted = None
        for name, key in FLOW_KEYS.items():
            desired, current = new[name], self.table(name)
            if current is None:
                current = desired.limit(0)
            for c in PRESERVED if name == "flows" else []:
                current = current if c in current.columns else current.withColumn(c, F.lit(None).cast("string"))
            plan = reconcile(current, desired, key, PRESERVED if name == "flows" else [])
            report[name] = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
            applied(plan).write.parquet(f"{at}/{name}")
            if name == "flows":
                deleted = orphans(plan, key)
        tables = {n: self.spark.read.parquet(f"{at}/{n}") for n in FLOW_KEYS}
        nodes = self.table("nodes")
        ids = tables["flows"].select(F.lit("Flow").alias("label"), F.col("flow_id").alias("id"))
        for n, label in (("messages", "Message"), ("events", "Event"), ("http_clients", "HttpClient")):
            ids = ids.union(tables[n].select(F.lit(label), "id"))
        if nodes is not None:
            ids = ids.union(nodes.select(F.lit("Node"), "node_id")).union(nodes.where("kind = 'Call'").select(F.lit("Call"), "node_id"))
        e = new["flow_edges"]
        made = e.join(ids.toDF("from_label", "from_id"), ["from_label", "from_id"], "left_semi").join(ids.toDF("to_label", "to_id"), ["to_label", "to_id"], "left_semi")
        made.select(*T.FLOW_EDGES.names).write.parquet(f"{at}/flow_edges")
        report["edges"] = {"wanted": e.count(), "made": self.spark.read.parquet(f"{at}/flow_edges").count()}
        written = [*FLOW_KEYS, "flow_edges"]
        v = self.table("embeddings")
        if v is not None and "flow_id" in v.columns and report["flows"].get("deleted"):
            without_orphans(v, deleted, "flow_id").write.parquet(f"{at}/embeddings")
            written.append("embeddings")
        self._switch(version, written)
        return report

    def enrich(self, sources: str, explain, embed, force: bool = False) -> dict:
        """Runs enrichment over all methods and classes whose file lies under sources; the numbers of each outcome.
        A node that has an explanation keeps it unless a new one is made."""
        nodes, version = self.table("nodes"), uuid.uuid4().hex
        at = f"{self.path}/{version}"
        old = [F.col(c) if c in nodes.columns else F.lit(None).cast("string").alias(c) for c in PRESERVED]
        known = nodes.select("node_id", *old)
        wanted = nodes.where(F.col("kind").isin(T.ENRICHABLE))
        scheme = r"^[a-z0-9+.\-]+:/*"
        top = re.sub(scheme, "/", sources.rstrip("/"))
        folder = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sources)
        own = F.regexp_replace("path", scheme, "/").substr(F.lit(len(top) + 2), F.length("path"))
        files = folder.select(own.alias("file"), F.col("content").cast("string").alias("text"))
        texts = X.source(files, wanted).select("node_id", "source")
        prompts = N.symbol_prompts(self.graph, texts)
        N.run(prompts, known.where("explanation is not null").select(F.col("node_id").alias("id")), explain, embed, force).write.parquet(f"{at}/results")
        done = self.spark.read.parquet(f"{at}/results")
        said = done.where("status = 'done'").select(F.col("id").alias("node_id"), F.col("explanation").alias("said"), "vector")
        both = nodes.drop(*PRESERVED).join(known, "node_id").join(said.drop("vector"), "node_id", "left")
        both = both.withColumns({"explanation": F.coalesce("said", "explanation"), "explain_model": F.when(F.col("said").isNotNull(), "explain").otherwise(F.col("explain_model"))}).drop("said")
        both.sortWithinPartitions("kind", "fqn").write.parquet(f"{at}/nodes")
        name = F.lit("explain_embeddings")
        vectors = said.select(F.xxhash64("node_id", name).alias("vec_id"), name.alias("collection"), "node_id", F.col("vector").alias("embedding"))
        if (v := self.table("embeddings")) is not None:
            other = v.join(vectors.select("node_id", "collection"), ["node_id", "collection"], "left_anti")
            vectors = other.unionByName(vectors, allowMissingColumns=True)
        vectors.write.parquet(f"{at}/embeddings")
        self._switch(version, ["nodes", "embeddings"])
        return N.totals(done).first().asDict()

    def verify(self) -> dict:
        """Rows and distinct ids of every table; they must agree."""
        out = {}
        for name, key in {"nodes": "node_id", **FLOW_KEYS}.items():
            if (t := self.table(name)) is not None:
                r = t.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids")).first()
                out[name] = {"rows": r.rows, "ids": r.ids, "unique": r.rows == r.ids}
        return out

    def reset(self) -> None:
        """An empty project."""
        version = uuid.uuid4().hex
        self.spark.createDataFrame([], T.NODES).write.parquet(f"{self.path}/{version}/nodes")
        self.spark.createDataFrame([], T.EDGES).write.parquet(f"{self.path}/{version}/edges")
        self._switch(version, ["nodes", "edges"], keep=False)
