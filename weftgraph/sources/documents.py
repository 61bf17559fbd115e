"""Symbol and application-flow documents in JSON, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as T
from ..functions.text import signature
from .elements import objects

DEFAULT_NAMESPACES = ("App\\",)


def _full(column):
    """An empty string or list is none at all."""
    return F.when(F.length(column) > 0, column)


def _arrays(schema, *names: str) -> dict:
    """The schemas of the objects in a document's arrays."""
    return {n: schema[n].dataType.elementType for n in names or schema.names}


def read_symbols(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of symbol documents, in the schemas NODES and EDGES. Places in the document become
    node_ord and edge_ord. A document of any size is read by many tasks (`elements.py`)."""
    found = objects(spark, path, _arrays(T.DOCUMENT, "nodes", "edges"))
    n = found["nodes"].select(F.col("place").alias("node_ord"), F.col("x").alias("n"))
    flat = lambda r, p="": [F.col(f"n.{r}.{c}").alias(f"{p}{c}") for c in ("start_line", "start_col", "end_line", "end_col")]
    docs = F.when(F.size("n.documentation") > 0, F.col("n.documentation"))
    sign = signature(F.col("n.kind"), F.col("n.documentation"))
    nodes = n.select(
        F.col("node_ord").cast("long").alias("node_ord"), F.col("n.id").alias("node_id"), "n.kind", "n.name", "n.fqn", "n.symbol", _full(F.col("n.file")).alias("file"),
        *flat("range"), *flat("enclosing_range", "enclosing_"), docs.alias("documentation"),
        *[_full(F.col(f"n.{c}")).alias(c) for c in ("value_kind", "type_symbol", "call_kind")], sign.alias("signature"),
    )
    e = found["edges"].select(F.col("place").alias("edge_ord"), F.col("x").alias("e")).select(
        F.col("edge_ord").cast("long").alias("edge_ord"), F.upper("e.type").alias("type"), F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"),
        F.col("e.location.file").alias("loc_file"), F.col("e.location.line").alias("loc_line"), F.col("e.position").alias("position"), _full(F.col("e.expression")).alias("expression"), _full(F.col("e.parameter")).alias("parameter"),
    )
    inside = contains_ordinal(e.where("type = 'CONTAINS'"), "edge_ord")
    return nodes.select(*T.NODES.names), inside.unionByName(e.where("type <> 'CONTAINS'").withColumn("ordinal", F.lit(None).cast("int"))).select(*T.EDGES.names)


def contains_ordinal(edges: DataFrame, order: str) -> DataFrame:
    """edges with each one's place among its source's, from 0."""
    return edges.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id").orderBy(order)) - 1)


def flow_name(kind, entry):
    """Verbs and route, the last part of the class, or the command."""
    last = lambda c: F.element_at(F.split(F.coalesce(c, F.lit("")), r"\\"), -1)
    http = F.trim(F.concat(F.array_join(F.coalesce(entry.http_methods, F.array().cast("array<string>")), " "), F.lit(" "), F.coalesce(entry.route, F.lit(""))))
    return F.when(kind == "http", http).when(kind == "message", last(entry.message)).when(kind == "event", last(entry.event)).when(kind == "cli", F.coalesce(entry.command_name, F.lit(""))).otherwise("")


def read_flows(spark: SparkSession, path: str, namespaces: tuple[str, ...] = DEFAULT_NAMESPACES) -> dict[str, DataFrame]:
    """flows, messages, events, http_clients and flow_edges of an application-flow document. Only flows are
    filtered by namespace; edges to flows outside it are dropped when their ends are looked up."""
    found = objects(spark, path, _arrays(T.FLOW_DOCUMENT))
    f = found["flows"].select("x.*")
    inside = F.lit(False)
    for p in namespaces:
        inside = inside | F.col("entry.fqn").startswith(p)
    f = f.where(F.coalesce(inside, F.lit(False)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    only = lambda kind, c: F.when(F.col("type") == kind, c)
    flows = f.select(
        F.col("id").alias("flow_id"), text("type").alias("type"), flow_name(F.col("type"), F.col("entry")).alias("name"), text("entry.fqn").alias("entry_fqn"), text("entry.method").alias("entry_method"),
        only("http", text("entry.route")).alias("route"), only("http", F.coalesce("entry.http_methods", F.array().cast("array<string>"))).alias("http_methods"),
        only("message", text("entry.message")).alias("message_class"), only("event", text("entry.event")).alias("event_name"), only("cli", text("entry.command_name")).alias("command_name"),
    )
    m, e, h = (found[c].select("x.*") for c in ("messages", "events", "http_clients"))

    def edge(df, type_, a, a_id, b, b_id, call=None, priority=None):
        none = lambda t: F.lit(None).cast(t)
        out = df.select(F.lit(type_).alias("type"), F.lit(a).alias("from_label"), a_id.alias("from_id"), F.lit(b).alias("to_label"), b_id.alias("to_id"), (call if call is not None else none("string")).alias("call_node_id"), (priority if priority is not None else none("int")).alias("priority"))
        return out.where("from_id is not null and to_id is not null")

    c = F.col
    edges = edge(f, "FLOW_ENTRY", "Flow", c("id"), "Node", c("entry.method_node_id")).union(edge(f, "FLOW_ENTRY_CLASS", "Flow", c("id"), "Node", c("entry.node_id")))
    for df, label, kind in ((m, "Message", "EMITS"), (e, "Event", "EMITS"), (h, "HttpClient", "USES_HTTP_CLIENT")):
        s = df.select("id", F.explode("sources").alias("s"))
        edges = edges.union(edge(s, kind, "Flow", c("s.flow_id"), label, c("id"), c("s.call_node_id"))).union(edge(s, kind, "Call", c("s.call_node_id"), label, c("id")))
        node = "class_node_id" if label == "HttpClient" else "dispatched_class_node_id"
        edges = edges.union(edge(df, "OF_TYPE", label, c("id"), "Node", c(node)))
    edges = edges.union(edge(m.select("id", F.explode("targets").alias("t")), "HANDLED_BY", "Message", c("id"), "Flow", c("t.flow_id")))
    edges = edges.union(edge(e.select("id", F.explode("targets").alias("t")), "HANDLED_BY", "Event", c("id"), "Flow", c("t.flow_id"), priority=F.coalesce("t.priority", F.lit(0))))
    return {
        "flows": flows,
        "messages": m.select("id", c("dispatched_class").alias("fqn"), F.coalesce("transports", F.array().cast("array<string>")).alias("transports")),
        "events": e.select("id", c("dispatched_class").alias("fqn")),
        "http_clients": h.select("id", "service_id", c("class").alias("class_fqn"), "base_uri"),
        "flow_edges": edges.distinct(),
    }
