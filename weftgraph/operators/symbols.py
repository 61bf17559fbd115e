"""Resolution, containment, usages, dependencies, inheritance and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.expand import expand
from ..schema import CONTAINERS, SEARCHABLE

LIMIT = 100
FUZZY_LIMIT = 50


def normalized(query: str) -> str:
    return query.strip().lstrip("\\")


def _fuzzy(query: str) -> list:
    """Conditions of the stages after exact and case-insensitive names, in order."""
    q = normalized(query)
    short = q.split("::")[-1]
    bare = short.rstrip("()")
    return [F.col("fqn").endswith(q), F.col("name") == short, F.col("name") == bare if bare != short else F.lit(False), F.col("fqn").contains(q)]


def _hits(nodes: DataFrame, queries: list[str], stages) -> DataFrame:
    """nodes, a row for each query with the first of its stages (number, condition) that the node meets."""
    asked = []
    for q in queries:
        stage = F.lit(None).cast("long")
        for i, s in reversed(stages(q)):
            stage = F.when(s, F.lit(i).cast("long")).otherwise(stage)
        asked.append(F.struct(F.lit(q).alias("query"), stage.alias("stage")))
    hits = nodes.withColumn("hit", F.explode(F.filter(F.array(*asked), lambda h: h.stage.isNotNull())))
    return hits.select("*", "hit.stage", "hit.query").drop("hit")


def _decided(hits: DataFrame, least: dict[str, int]) -> DataFrame:
    """Of each query the hits of the stage that decides it."""
    if not least:
        return hits.where(F.lit(False))
    return hits.where(F.create_map(*[F.lit(x) for item in least.items() for x in item])[F.col("query")] == F.col("stage"))


def resolve_many(g: Graph, queries: list[str]) -> DataFrame:
    """For each query, the nodes of the first stage with hits, with the stage (from 1). Stages from the third on
    give the first FUZZY_LIMIT nodes of the graph; an exact hit on a value hides arguments of that name.
    Full names are looked up in the table sorted by them, which skips all row groups but a few; only queries
    that name nothing so read the searchable nodes, once for all of them."""
    columns = [*g.nodes.columns, "stage", "query"]
    if not queries:
        return g.nodes.where(F.lit(False)).withColumn("stage", F.lit(0).cast("long")).withColumn("query", F.lit("")).select(*columns)
    queries = list(dict.fromkeys(queries))
    lower = lambda q: F.lower(F.lit(normalized(q)))
    named = g.by_name.where(F.col("lower_fqn").isin(*[lower(q) for q in queries]))
    named = _hits(named, queries, lambda q: [(1, F.col("fqn") == normalized(q)), (2, F.col("lower_fqn") == lower(q))])
    best = named.groupBy("query").agg(F.min("stage").alias("least"), F.max((F.col("stage") == 1) & (F.col("kind") == "Value")).alias("value")).collect()  # a row a query
    values = [r.query for r in best if r.value]
    hidden = (F.col("stage") == 1) & (F.col("kind") == "Argument") & F.col("query").isin(values)
    out = _decided(named, {r.query: r.least for r in best}).where(~hidden).select(*columns)
    left = [q for q in queries if q not in {r.query for r in best}]
    if not left:
        return out
    any_of = F.lit(False)
    for q in left:
        for s in _fuzzy(q)[1:]:  # what ends with a text contains it
            any_of = any_of | s
    some = g.of_kind(*SEARCHABLE).where(any_of)
    hits = g.keep(_hits(some, left, lambda q: list(enumerate(_fuzzy(q), 3))), "fuzzy-hits")
    best = hits.groupBy("query").agg(F.min("stage").alias("least")).collect()  # a row a query
    place = F.row_number().over(Window.partitionBy("query").orderBy("node_ord"))  # that many rows a task go on
    fuzzy = _decided(hits, {r.query: r.least for r in best}).withColumn("place", place).where(F.col("place") <= FUZZY_LIMIT)
    return out.unionByName(fuzzy.select(*columns))


def resolve(g: Graph, query: str) -> DataFrame:
    """The nodes that one query names, as resolve_many has them."""
    return resolve_many(g, [query]).drop("query")


def owners(g: Graph, node_id: str) -> DataFrame:
    """The node (distance 0), its container, and so on up."""
    up = g.anc.where(F.col("node_id") == node_id).select(F.col("ancestor_id").alias("node_id"), "distance")
    both = g.nodes.where(F.col("node_id") == node_id).select("node_id").withColumn("distance", F.lit(0).cast("long")).unionByName(up)
    return both.join(g.nodes.select("node_id", "kind", "fqn", "file", "start_line"), "node_id")


def members(g: Graph, node_id: str) -> DataFrame:
    """The node and all it contains."""
    inside = g.anc.where(F.col("ancestor_id") == node_id).select("node_id")
    return g.nodes.where(F.col("node_id") == node_id).select("node_id").union(inside)


def _ordered(df: DataFrame) -> list:
    return [F.asc_nulls_last("loc_file"), F.asc_nulls_last("loc_line"), "source_id", "target_id"]


def usages_direct(g: Graph, node_id: str, limit: int = LIMIT) -> DataFrame:
    """Who uses the node; a missing place falls back on the source's own."""
    e = g.of_type("USES").where(F.col("target_id") == node_id)
    e = e.orderBy(*_ordered(e)).limit(limit)
    s = g.nodes.select(F.col("node_id").alias("source_id"), F.col("fqn").alias("source_fqn"), "file", "start_line")
    return e.join(s, "source_id").select("source_id", "target_id", "source_fqn", F.coalesce("loc_file", "file").alias("file"), F.coalesce("loc_line", "start_line").alias("line"))


def _first_of(e: DataFrame, key: str) -> DataFrame:
    """Numbered rows, the first of each key."""
    n = e.withColumn("place", F.row_number().over(Window.orderBy(*_ordered(e))).cast("long"))  # after a limit
    return n.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where("k = 1").drop("k")


def usages_members(g: Graph, node_id: str, limit: int = LIMIT) -> DataFrame:
    """Who uses the node or a member of it: the first ``limit`` edges by place, then one row a source. Values and calls
    are members that nothing uses."""
    own = g.spark.range(1).select(F.lit(node_id).alias("target_id"))
    inside = g.above("Method", "Function", "Argument", "Property").where(F.col("ancestor_id") == node_id).select(F.col("node_id").alias("target_id")).union(own)
    e = g.of_type("USES").join(inside, "target_id", "left_semi")
    e = _first_of(e.orderBy(*_ordered(e)).limit(limit), "source_id")
    s = g.ends("source", "USES").select(F.col("node_id").alias("source_id"), F.col("fqn").alias("source_fqn"), "file", "start_line")
    return e.join(s, "source_id").select("place", "source_id", "target_id", "source_fqn", F.coalesce("loc_file", "file").alias("file"), F.coalesce("loc_line", "start_line").alias("line"))


def deps_direct(g: Graph, node_id: str, limit: int = LIMIT) -> DataFrame:
    """What the node uses; a missing file falls back on the target's, a missing line stays missing."""
    e = g.of_type("USES").where(F.col("source_id") == node_id)
    e = e.orderBy(*_ordered(e)).limit(limit)
    t = g.nodes.select(F.col("node_id").alias("target_id"), F.col("fqn").alias("target_fqn"), "file")
    return e.join(t, "target_id").select("source_id", "target_id", "target_fqn", F.coalesce("loc_file", "file").alias("file"), F.col("loc_line").alias("line"))


def deps_members(g: Graph, node_id: str, limit: int = LIMIT) -> DataFrame:
    inside = members(g, node_id).withColumnRenamed("node_id", "source_id")
    e = g.of_type("USES").join(inside, "source_id", "left_semi")
    e = _first_of(e.orderBy(*_ordered(e)).limit(limit), "target_id")
    t = g.nodes.select(F.col("node_id").alias("target_id"), F.col("fqn").alias("target_fqn"), "file")
    return e.join(t, "target_id").select("place", "source_id", "target_id", "target_fqn", F.coalesce("loc_file", "file").alias("file"), F.col("loc_line").alias("line"))


def usages(g: Graph, node_id: str, limit: int = LIMIT) -> DataFrame:
    """With member expansion for containers, if that finds anything; else direct."""
    kind = g.nodes.where(F.col("node_id") == node_id).select("kind").first()
    if kind and kind.kind in CONTAINERS:
        found = usages_members(g, node_id, limit)
        if found.head(1):
            return found.drop("place")
    return usages_direct(g, node_id, limit)


def levels(g: Graph, node_id: str, pairs: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth) within depth hops along pairs, each node once."""
    start = g.nodes.where(F.col("node_id") == node_id).select(F.col("node_id").alias("root_id"), "node_id")
    return expand(start, pairs, depth, g.keep).select("node_id", "depth")


def along(g: Graph, types: list[str], up: bool) -> DataFrame:
    a, b = ("source_id", "target_id") if up else ("target_id", "source_id")
    return g.of_type(*types).select(F.col(a).alias("node_id"), F.col(b).alias("next_id")).distinct()


def _within(table: DataFrame, node_id: str, up: bool, depth: int) -> DataFrame:
    """(node_id, depth) from a stored closure; in a cycle the node itself is left out."""
    here, there = ("node_id", "ancestor_id") if up else ("ancestor_id", "node_id")
    found = table.where((F.col(here) == node_id) & (F.col("distance") <= depth) & (F.col(there) != node_id))
    return found.select(F.col(there).alias("node_id"), F.col("distance").alias("depth"))


def inherit(g: Graph, node_id: str, up: bool, depth: int = 5) -> DataFrame:
    """(node_id, depth) of one node's super- or subtypes: a step is a join of the few found last, where no closure is stored."""
    if g.stores("inherits"):
        return _within(g.inherits, node_id, up, depth)
    start = g.spark.range(1).select(F.lit(node_id).alias("root_id"), F.lit(node_id).alias("node_id"))
    here, there = ("source_id", "target_id") if up else ("target_id", "source_id")
    pairs = g.of_type("EXTENDS", "IMPLEMENTS").select(F.col(here).alias("node_id"), F.col(there).alias("next_id"))
    return expand(start, pairs, depth, g.keep).select("node_id", "depth")


def overrides(g: Graph, node_id: str, up: bool, depth: int = 5) -> DataFrame:
    return _within(g.overriding, node_id, up, depth)


def internal_references(g: Graph) -> DataFrame:
    """References whose target contains their source, by type of edge, next to all."""
    members = "Method", "Function", "Argument", "Property"  # what is at either end of a reference, next to classes
    own = g.above(*members).select(F.col("node_id").alias("source_id"), F.col("ancestor_id").alias("target_id"), F.lit(1).alias("inside"))
    up = g.class_of(*members).select(F.col("node_id").alias("target_id"), F.col("owner_id"))
    # a reference is internal if its target, or the class around its target, is around the source
    r = g.of_type("USES", "EXTENDS", "IMPLEMENTS", "USES_TRAIT").select("type", "source_id", "target_id").join(up, "target_id", "left").withColumn("cls", F.coalesce("owner_id", "target_id"))
    r = r.join(own.withColumnRenamed("target_id", "cls"), ["source_id", "cls"], "left")
    return r.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("inside").alias("internal"))
