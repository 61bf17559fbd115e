"""Smaller facts behind contexts, definitions and enrichment, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import TYPES, call_reference, priority
from ..functions.text import display_name, shorten_parameter, truncated
from ..graph import Graph, ProjectedGraph
from ..plans.expand import expand
from ..schema import NODE_KINDS


def _contains(g: Graph, up: str, down: str, *kinds: str) -> DataFrame:
    return g.containing(*(kinds or NODE_KINDS)).select(F.col("source_id").alias(up), F.col("target_id").alias(down))


def _names(g: Graph, key: str, *columns: str) -> DataFrame:
    return g.nodes.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{key[:-3]}_{c}") for c in columns])


def override_methods(g: Graph) -> DataFrame:
    """(method_id, parent_id, class_id, parent_class_id): overriding methods with the classes of both."""
    e = g.of_type("OVERRIDES").select(F.col("source_id").alias("method_id"), F.col("target_id").alias("parent_id"))
    return e.join(_contains(g, "class_id", "method_id", "Method"), "method_id").join(_contains(g, "parent_class_id", "parent_id", "Method"), "parent_id")


def interface_methods(g: Graph) -> DataFrame:
    """Contract methods: of each interface, its own methods by name."""
    i = g.of_kind("Interface").select(F.col("node_id").alias("interface_id"))
    m = g.of_kind("Method").select(F.col("node_id").alias("method_id"), F.col("name").alias("method_name"))
    return _contains(g, "interface_id", "method_id", "Method").join(i, "interface_id").join(m, "method_id")


def signature_types(g: Graph) -> DataFrame:
    """(method_id, type_id, type_name): hints of methods, with the class they stand in."""
    m = g.of_kind("Method").select(F.col("node_id").alias("method_id"))
    e = g.of_type("TYPE_HINT").select(F.col("source_id").alias("method_id"), F.col("target_id").alias("type_id")).join(m, "method_id")
    return e.join(g.ends("target", "TYPE_HINT").select(F.col("node_id").alias("type_id"), F.col("name").alias("type_name")), "type_id").join(_contains(g, "class_id", "method_id", "Method"), "method_id")


def source_chains(g: Graph) -> DataFrame:
    """Of each argument that is a call's result: that call's callee as displayed, and the kind of reference."""
    a = g.args.where("source_call_id is not null").select("call_id", "position", "value_id", "source_call_id")
    c = g.calls.select(F.col("call_id").alias("source_call_id"), display_name(F.col("callee_kind"), F.col("callee_name")).alias("made_by"), call_reference(F.col("call_kind"), F.col("callee_kind")).alias("ref_type"))
    return a.join(c, "source_call_id")


def argument_keys(g: Graph) -> DataFrame:
    """Arguments as output shows them: key, value, kind; without a parameter the position is the key."""
    return g.args.select("call_id", "value_id", F.coalesce(shorten_parameter(F.col("parameter")), F.concat(F.lit("arg"), "position")).alias("key"), F.coalesce("expression", "value_name").alias("shown"), "value_kind")


def member_dependencies(g: Graph) -> DataFrame:
    """(class_id, member_id, target_id): what members of a class use outside it."""
    m = g.of_kind("Method", "Property").select(F.col("node_id").alias("member_id"))
    u = g.of_type("USES").select(F.col("source_id").alias("member_id"), "target_id").join(m, "member_id").join(_contains(g, "class_id", "member_id", "Method", "Property"), "member_id")
    inside = g.above("Method", "Function", "Argument", "Property").select(F.col("node_id").alias("target_id"), F.col("ancestor_id").alias("class_id"))
    return u.join(inside, ["target_id", "class_id"], "left_anti")


def constructor_targets(g: Graph) -> DataFrame:
    """(scope_id, class_id): classes that a method instantiates."""
    return g.sites.where("call_kind = 'constructor'").join(_contains(g, "class_id", "callee_id"), "callee_id").select("scope_id", "class_id").distinct()


def target_classes(g: Graph) -> DataFrame:
    """Of each used symbol: itself if it is a class, else its direct container if that is one."""
    cls = g.of_kind(*TYPES).select(F.col("node_id").alias("owner_id"))
    t = g.of_type("USES").select("target_id").distinct().join(g.ends("target", "USES").select(F.col("node_id").alias("target_id"), "kind"), "target_id")
    up = _contains(g, "owner_id", "target_id").join(cls, "owner_id")
    t = t.join(up, "target_id", "left").select("target_id", F.when(F.col("kind").isin(*TYPES), F.col("target_id")).otherwise(F.col("owner_id")).alias("class_id"))
    return t.where("class_id is not null")


def merged_sites(g: Graph) -> DataFrame:
    """Per class and callee: its call sites as method:line, and the line if there is one site only."""
    c = g.sites.where("callee_id is not null").join(g.class_of("Call").select(F.col("node_id").alias("call_id"), F.col("owner_id").alias("class_id")), "call_id")
    site = F.concat("scope_id", F.lit(":"), F.coalesce(F.col("call_line").cast("string"), F.lit("?")))
    return c.groupBy("class_id", "callee_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(site)), ",").alias("sites"), F.when(F.count(F.lit(1)) == 1, F.min("call_line")).alias("line"))


def access_counts(g: Graph) -> DataFrame:
    """Per property: accesses, and the methods they come from."""
    a = g.refs_to("Property").where("ref_type = 'property_access'")
    return a.groupBy(F.col("target_id").alias("property_id")).agg(F.count(F.lit(1)).alias("accesses"), F.countDistinct("source_id").alias("methods"))


def return_flows(g: Graph) -> DataFrame:
    """(result_id, local_id, type_ok): results assigned to locals, and whether both have one type."""
    t = g.of_type("TYPE_OF").select(F.col("source_id").alias("v"), F.col("target_id").alias("t"))
    e = g.of_type("ASSIGNED_FROM").select(F.col("source_id").alias("local_id"), F.col("target_id").alias("result_id"))
    e = e.join(t.toDF("local_id", "local_type"), "local_id", "left").join(t.toDF("result_id", "result_type"), "result_id", "left")
    return e.select("result_id", "local_id", F.coalesce(F.col("local_type") == F.col("result_type"), F.lit(False)).alias("type_ok"))


def class_expansion(g: Graph, node_id: str, depth: int = 2) -> DataFrame:
    """(node_id, depth): classes reached by extending, or by what members use, within some hops."""
    up = g.of_type("EXTENDS").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("next_id"))
    m = member_dependencies(g).select(F.col("class_id").alias("node_id"), "target_id").join(target_classes(g), "target_id").select("node_id", F.col("class_id").alias("next_id"))
    start = g.nodes.where(F.col("node_id") == node_id).select(F.col("node_id").alias("root_id"), "node_id")
    return expand(start, up.union(m).distinct(), depth, g.keep).select("node_id", "depth")


def ranked_references(g: Graph) -> DataFrame:
    """Per target: references by priority, how many of each, and the best."""
    r = g.refs_to().withColumn("priority", priority(F.col("ref_type")))
    return r.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("best"), F.countDistinct("ref_type").alias("kinds"))


def methods_in_order(g: Graph) -> DataFrame:
    """Per class: its methods by start line, as one string, as chunking takes them."""
    m = g.of_kind("Method").select(F.col("node_id").alias("method_id"), "start_line")
    m = _contains(g, "class_id", "method_id", "Method").join(m, "method_id")
    order = F.sort_array(F.collect_list(F.struct("start_line", "method_id")))
    return m.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(order, lambda x: x.method_id), ",").alias("methods"))


def whole_chunks(nodes: DataFrame, docs: DataFrame, max_tokens: int) -> DataFrame:
    """One chunk of each text, whole or cut, by the kind of its node."""
    n = docs.join(nodes, "node_id")
    return n.select("node_id", "kind", F.length(truncated(F.col("text"), max_tokens)).cast("long").alias("chars"), (F.length("text") > max_tokens * 4).alias("cut"))


def class_prefixes(docs: DataFrame, lines: int = 20) -> DataFrame:
    """The head of a class without known methods: its first lines."""
    return docs.select("doc_id", F.md5(F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").cast("binary")).alias("prefix_md5"))
