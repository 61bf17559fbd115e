"""What a symbol is: parts, types, supertypes, flags. For all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_abstract, property_facts
from ..graph import Graph


def _joined(column, sep: str = "|"):
    return F.array_join(F.sort_array(F.collect_set(column)), sep)


def parents(g: Graph) -> DataFrame:
    """Each node with its direct container, or null."""
    up = g.of_type("CONTAINS").select(F.col("target_id").alias("node_id"), F.col("source_id").alias("parent_id"))
    return g.nodes.select("node_id", "kind", "fqn").join(up, "node_id", "left")


def children(g: Graph) -> DataFrame:
    """Per container and kind of child: how many, and the first in order."""
    k = g.nodes.select(F.col("node_id").alias("target_id"), F.col("kind").alias("child_kind"), "node_ord")
    c = g.of_type("CONTAINS").select("source_id", "target_id").join(k, "target_id")
    return c.groupBy("source_id", "child_kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node_ord", "target_id")).alias("m")).select("source_id", "child_kind", "n", F.col("m.target_id").alias("first_child"))


def types(g: Graph, *kinds: str) -> DataFrame:
    """Types of properties, methods and values: the first hint's name, or all types of a value, joined. By edges of
    these kinds, or both."""
    kinds = kinds or ("TYPE_HINT", "TYPE_OF")
    n = g.ends("target", *kinds).select(F.col("node_id").alias("target_id"), "fqn")
    t = g.of_type(*kinds).select("type", "source_id", "target_id").join(n, "target_id")
    return t.groupBy("source_id", "type").agg(_joined("fqn").alias("fqn"), F.count(F.lit(1)).alias("n"))


def supertypes(g: Graph) -> DataFrame:
    """Per class: what it extends, implements, and uses as traits, joined."""
    n = g.ends("target", "EXTENDS", "IMPLEMENTS", "USES_TRAIT").select(F.col("node_id").alias("target_id"), "fqn")
    e = g.of_type("EXTENDS", "IMPLEMENTS", "USES_TRAIT").select("type", "source_id", "target_id").join(n, "target_id")
    of = lambda t: _joined(F.when(F.col("type") == t, F.col("fqn")))
    return e.groupBy("source_id").agg(of("EXTENDS").alias("extends"), of("IMPLEMENTS").alias("implements"), of("USES_TRAIT").alias("traits"))


def method_flags(g: Graph) -> DataFrame:
    """Per method: does it override one, is it a constructor, and its display order (overriding first)."""
    over = g.of_type("OVERRIDES").select(F.col("source_id").alias("node_id")).distinct().withColumn("o", F.lit(True))
    m = g.of_kind("Method").join(over, "node_id", "left")
    o = F.coalesce("o", F.lit(False))
    return m.select("node_id", o.alias("is_override"), (F.col("name") == "__construct").alias("is_constructor"), F.when(o, 0).otherwise(2).cast("long").alias("place"))


def promoted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(property_id, parameter_id): properties assigned from a constructor's parameter."""
    p = nodes.where("kind = 'Property'").select(F.col("node_id").alias("source_id"))
    v = nodes.where(F.col("fqn").contains("__construct()")).select(F.col("node_id").alias("target_id"))
    e = edges.where("type = 'ASSIGNED_FROM'").select("source_id", "target_id")
    return e.join(p, "source_id").join(v, "target_id").select(F.col("source_id").alias("property_id"), F.col("target_id").alias("parameter_id"))


def value_types(g: Graph) -> DataFrame:
    """Per value: kind, type, and the method around it."""
    v = g.of_kind("Value").select("node_id", "value_kind")
    t = types(g, "TYPE_OF").select(F.col("source_id").alias("node_id"), F.col("fqn").alias("type_fqn"))
    return v.join(t, "node_id", "left").join(g.method_of("Value").select("node_id", F.col("owner_id").alias("scope_id")), "node_id", "left")


def property_docs(docs: DataFrame) -> DataFrame:
    """docs (name, documentation) with visibility, readonly, static and type, and whether a method there is
    abstract."""
    f = property_facts(F.col("documentation"), F.col("name"))
    return docs.withColumn("f", f).select("name", "f.visibility", "f.readonly", "f.static", "f.type", is_abstract(F.col("documentation")).alias("abstract"))
