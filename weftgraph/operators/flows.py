"""Application flows: what they dispatch, what handles them; lists, searches and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import ProjectedGraph

FIND_LIMIT = 50


def list_flows(g: ProjectedGraph, types: list[str] | None = None) -> DataFrame:
    """Flows with the method they enter at, by type and id."""
    f = g.flows.where(F.col("type").isin(types)) if types else g.flows
    m = g.nodes.select(F.col("node_id").alias("method_node_id"), F.col("fqn").alias("entry_fqn"))
    return f.join(m, "method_node_id", "left").select("flow_id", "type", "class_node_id", "method_node_id", "entry_fqn").orderBy("type", "flow_id")


def _holds(column: str, q: str) -> Column:
    return F.lower(column).contains(q.lower())


def find(df: DataFrame, key: str, others: list[str], query: str, limit: int = FIND_LIMIT) -> DataFrame:
    """Exact hits on the key; where there are none, rows with the query in any of the columns, by key."""
    both = df.withColumn("exact", F.col(key) == query)
    part = _holds(key, query)
    for c in others:
        part = part | F.coalesce(_holds(c, query), F.lit(False))
    hits = both.where(F.col("exact") | part)
    best = hits.agg(F.max("exact").alias("exact"))
    return hits.join(F.broadcast(best), "exact").drop("exact").orderBy(key).limit(limit)  # one row


def find_flow(g: ProjectedGraph, query: str) -> DataFrame:
    return find(list_flows(g), "flow_id", ["entry_fqn", "type"], query)


def dispatches_out(g: ProjectedGraph) -> DataFrame:
    """Per flow and message or event: calls that emit it, and the flows that handle it."""
    h = g.handled_by.groupBy(F.col("from_id").alias("to_id")).agg(F.countDistinct("flow_id").alias("handlers"))
    e = g.emits.groupBy("flow_id", "to_label", "to_id").agg(F.countDistinct("call_node_id").alias("calls"), F.count(F.lit(1)).alias("n"))
    return e.join(h, "to_id", "left").select("flow_id", "to_label", "to_id", "calls", "n", F.coalesce("handlers", F.lit(0)).alias("handlers"))


def dispatches_in(g: ProjectedGraph) -> DataFrame:
    """Per flow: what it handles, and how many flows emit that."""
    e = g.emits.groupBy(F.col("to_id").alias("from_id")).agg(F.countDistinct("flow_id").alias("emitters"))
    return g.handled_by.join(e, "from_id", "left").select("flow_id", "from_label", "from_id", "priority", F.coalesce("emitters", F.lit(0)).alias("emitters"))


def list_entities(g: ProjectedGraph, label: str) -> DataFrame:
    """Messages or events with numbers of distinct sources and targets; one that has only either counts too."""
    s = g.emits.where(F.col("to_label") == label).select(F.col("to_id").alias("id"), F.col("flow_id").alias("source"), F.lit(None).cast("string").alias("target"))
    t = g.handled_by.where(F.col("from_label") == label).select(F.col("from_id").alias("id"), F.lit(None).cast("string"), "flow_id")
    return s.union(t).groupBy("id").agg(F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def list_http_clients(g: ProjectedGraph) -> DataFrame:
    """Clients, and the flows that use them in error events."""
    used = g.emits.where("event_type = 'error' and k is not null").groupBy("k").agg(F.countDistinct("flow_id").alias("flows"))
    every = g.emits.where("k is not null").select("k").distinct()
    return every.join(used, "k", "left").select(F.concat(F.lit("http:"), "k").alias("id"), F.coalesce("flows", F.lit(0)).alias("flows"))


def entity_detail(g: ProjectedGraph, entity: str) -> DataFrame:
    """Who emits a message or event and who handles it, with priorities."""
    s = g.emits.where(F.col("to_id") == entity).groupBy("flow_id").agg(F.countDistinct("call_node_id").alias("calls"))
    t = g.handled_by.where(F.col("from_id") == entity).select("flow_id", "priority")
    side = lambda df, name, calls, priority: df.select(F.lit(name).alias("side"), "flow_id", calls.cast("long").alias("calls"), priority.cast("long").alias("priority"))
    return side(s, "source", F.col("calls"), F.lit(None)).union(side(t, "target", F.lit(None), F.col("priority")))


def flow_names(g: ProjectedGraph) -> DataFrame:
    """Display names: verb and route, the last part of a class name, or the command."""
    m = g.nodes.select(F.col("node_id").alias("class_node_id"), F.col("fqn").alias("class_fqn"))
    f = g.flows.join(m, "class_node_id")
    last = F.element_at(F.split("class_fqn", r"\\"), -1)
    name = F.when(F.col("type") == "http", F.concat(F.lit("GET /"), F.col("user_id"))).when(F.col("type").isin("message", "event"), last).otherwise(F.concat(F.lit("app:"), F.col("user_id")))
    return f.select("flow_id", name.alias("name"))


def in_namespaces(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose name starts with any of the prefixes."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col(column).startswith(p)
    return df.where(F.coalesce(test, F.lit(False)))


def dispatch_context(g: ProjectedGraph) -> DataFrame:
    """Per flow: distinct messages, events, clients and handled ids, each as one string."""
    names = lambda t: F.array_join(F.sort_array(F.collect_set(t)), ",")
    e = g.emits.groupBy("flow_id").agg(
        names(F.when(F.col("to_label") == "Message", F.col("to_id"))).alias("messages"),
        names(F.when(F.col("to_label") == "Event", F.col("to_id"))).alias("events"),
    )
    h = g.handled_by.groupBy("flow_id").agg(names("from_id").alias("handles"))
    return g.flows.select("flow_id").join(e, "flow_id", "left").join(h, "flow_id", "left").select("flow_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("messages", "events", "handles")])
