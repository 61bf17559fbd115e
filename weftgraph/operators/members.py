"""Definitions by kind of symbol, and what is reached through properties. For all symbols at once.

Where the graph has several types of one symbol, the first by id stands. Children go by their place in the
graph (node_ord). Facts that only documentation tells (visibility, modifiers, types without an edge) come in
where nodes have documentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import TYPES, call_reference
from ..functions.text import display_name, is_abstract, property_facts
from ..graph import Graph
from ..plans.expand import expand
from ..plans.product import paired
from .context import CALLED


def _contains(g: Graph, up: str, down: str) -> DataFrame:
    """CONTAINS edges of all but values and calls, after which nothing here asks."""
    return g.containing(*CALLED).select(F.col("source_id").alias(up), F.col("target_id").alias(down))


def _documentation(g: Graph) -> Column:
    return F.col("documentation") if "documentation" in g.of_kind("Class").columns else F.lit(None).cast("array<string>")


def _of_kind(g: Graph, key: str, *kinds: str) -> DataFrame:
    """Nodes of these kinds, with what a definition reads."""
    n = g.of_kind(*kinds)
    signature = F.col("signature") if "signature" in n.columns else F.lit(None).cast("string")
    return n.select(F.col("node_id").alias(key), "kind", "name", "node_ord", _documentation(g).alias("documentation"), signature.alias("signature"))


def first_types(g: Graph, *kinds: str) -> DataFrame:
    """(node_id, type_fqn, type_name): the first type of each symbol by edges of these kinds."""
    n = g.ends("target", *kinds).select(F.col("node_id").alias("target_id"), "fqn", "name")
    e = g.of_type(*kinds).select(F.col("source_id").alias("node_id"), "target_id").join(n, "target_id")
    return e.groupBy("node_id").agg(F.min(F.struct("target_id", "fqn", "name")).alias("t")).select("node_id", F.col("t.fqn").alias("type_fqn"), F.col("t.name").alias("type_name"))


def _promoted(g: Graph) -> DataFrame:
    """(property_id, parameter_id): properties that a constructor's parameter is assigned to."""
    v = g.nodes.where(F.col("fqn").contains("__construct()") & (F.col("kind") == "Value") & (F.col("value_kind") == "parameter")).select(F.col("node_id").alias("parameter_id"))
    p = g.of_kind("Property").select(F.col("node_id").alias("property_id"))
    e = g.of_type("ASSIGNED_FROM").select(F.col("source_id").alias("property_id"), F.col("target_id").alias("parameter_id"))
    return e.join(p, "property_id").join(v, "parameter_id")


# --- definitions ---


def method_definitions(g: Graph) -> DataFrame:
    """Per method and function: its arguments in order, name:type each, and what it returns."""
    own = _of_kind(g, "node_id", "Method", "Function").select("node_id")
    hints = first_types(g, "TYPE_HINT")
    a = _of_kind(g, "argument_id", "Argument").join(_contains(g, "node_id", "argument_id"), "argument_id").join(hints.withColumnRenamed("node_id", "argument_id"), "argument_id", "left")
    shown = F.concat("name", F.coalesce(F.concat(F.lit(":"), "type_name"), F.lit("")))
    a = a.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("node_ord", shown.alias("shown")))).alias("a"))  # a signature's worth
    out = own.join(a, "node_id", "left").join(hints, "node_id", "left")
    return out.select("node_id", F.array_join(F.transform("a", lambda x: x.shown), ",").alias("arguments"), F.col("type_fqn").alias("return_fqn"), F.col("type_name").alias("return_name"))


def argument_definitions(g: Graph) -> DataFrame:
    """Per argument: its declared type."""
    return _of_kind(g, "node_id", "Argument").select("node_id", "name").join(first_types(g, "TYPE_HINT"), "node_id", "left")


def property_definitions(g: Graph) -> DataFrame:
    """Per property: type (by edge, else as documented), visibility, readonly (its own or its class's), static,
    and whether a constructor's parameter is promoted to it."""
    p = _of_kind(g, "node_id", "Property").withColumn("f", property_facts(F.col("documentation"), F.col("name")))
    cls = _of_kind(g, "class_id", "Class").select("class_id", F.coalesce(F.exists("documentation", lambda d: d.contains("readonly ")), F.lit(False)).alias("frozen"))
    up = _contains(g, "class_id", "node_id").join(cls, "class_id").groupBy("node_id").agg(F.max("frozen").alias("frozen"))
    promoted = _promoted(g).select(F.col("property_id").alias("node_id")).distinct().withColumn("p", F.lit(True))
    out = p.join(first_types(g, "TYPE_HINT"), "node_id", "left").join(up, "node_id", "left").join(promoted, "node_id", "left")
    return out.select(
        "node_id", "name", F.coalesce("type_fqn", "f.type").alias("type_fqn"), F.coalesce("type_name", "f.type").alias("type_name"), F.col("f.visibility").alias("visibility"),
        (F.col("f.readonly") | F.coalesce("frozen", F.lit(False))).alias("readonly"), F.col("f.static").alias("static"), F.coalesce("p", F.lit(False)).alias("promoted"),
    )


def class_properties(g: Graph) -> DataFrame:
    """Per class, trait and enum: its properties in order, as property_definitions has them, and whether each
    is what its constructor depends on. readonly is the property's own here."""
    cls = _of_kind(g, "class_id", "Class", "Trait", "Enum").select("class_id")
    p = _of_kind(g, "node_id", "Property").select("node_id", "node_ord", property_facts(F.col("documentation"), F.col("name")).readonly.alias("own"))
    rows = _contains(g, "class_id", "node_id").join(cls, "class_id").join(p, "node_id").join(property_definitions(g).drop("readonly"), "node_id")
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("node_ord", "node_id")).cast("long")
    return rows.select("class_id", place.alias("place"), F.col("node_id").alias("property_id"), "name", "type_name", "visibility", F.col("own").alias("readonly"), "static", "promoted")


def constructor_dependencies(g: Graph) -> DataFrame:
    """Per class: its promoted properties in order, with their types."""
    p = class_properties(g).where("promoted")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy("place")).cast("long")).select("class_id", "place", "name", "type_name")


def class_methods(g: Graph) -> DataFrame:
    """Per class, trait and enum: its methods but constructors, overriding ones first, with signature and tags."""
    cls = _of_kind(g, "class_id", "Class", "Trait", "Enum").select("class_id")
    over = g.of_type("OVERRIDES").select(F.col("source_id").alias("method_id")).distinct().withColumn("o", F.lit(True))
    m = _of_kind(g, "method_id", "Method").where("name <> '__construct'").join(over, "method_id", "left")
    rows = _contains(g, "class_id", "method_id").join(cls, "class_id").join(m, "method_id")
    overriding = F.coalesce("o", F.lit(False))
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.when(overriding, 0).otherwise(2), "node_ord", "method_id")).cast("long")
    tags = F.concat_ws(",", F.when(overriding, "override"), F.when(is_abstract(F.col("documentation")), "abstract"))
    return rows.select("class_id", place.alias("place"), "method_id", "name", "signature", tags.alias("tags"))


def interface_definitions(g: Graph) -> DataFrame:
    """Per interface: the methods it declares, in order, and the interface it extends."""
    i = _of_kind(g, "interface_id", "Interface").select("interface_id")
    m = _of_kind(g, "method_id", "Method").join(_contains(g, "interface_id", "method_id"), "method_id")
    m = m.groupBy("interface_id").agg(F.sort_array(F.collect_list(F.struct("node_ord", "name"))).alias("m"))
    up = first_types(g, "EXTENDS").select(F.col("node_id").alias("interface_id"), F.col("type_fqn").alias("extends"))
    out = i.join(m, "interface_id", "left").join(up, "interface_id", "left")
    return out.select("interface_id", F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("methods"), "extends")


def value_definitions(g: Graph) -> DataFrame:
    """Per value: kind, types (all of a union), and where it comes from: the property it is promoted to, the
    callee whose result it is assigned from, or, of a result, the callee itself."""
    n = g.nodes.select(F.col("node_id").alias("target_id"), "fqn", "name")
    t = g.of_type("TYPE_OF").select(F.col("source_id").alias("node_id"), "target_id").join(n, "target_id")
    t = t.groupBy("node_id").agg(F.sort_array(F.collect_set(F.struct("target_id", "fqn", "name"))).alias("t"))  # a union type's worth
    v = g.of_kind("Value").select("node_id", "value_kind")
    calls = g.calls.where("callee_id is not null").select("call_id", "callee_fqn", display_name(F.col("callee_kind"), F.col("callee_name")).alias("callee_name"))
    made = g.of_type("PRODUCES").select(F.col("source_id").alias("call_id"), F.col("target_id").alias("from_id")).join(calls, "call_id")
    made = made.groupBy("from_id").agg(F.min(F.struct("call_id", "callee_fqn", "callee_name")).alias("c"))
    kinds = g.nodes.select(F.col("node_id").alias("from_id"), F.col("kind").alias("from_kind"), F.col("fqn").alias("from_fqn"))
    a = g.of_type("ASSIGNED_FROM").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("from_id")).groupBy("node_id").agg(F.min("from_id").alias("from_id"))
    a = a.join(kinds, "from_id").join(made, "from_id", "left").select("node_id", "from_kind", "from_fqn", F.col("c").alias("assigned"))
    out = v.join(t, "node_id", "left").join(a, "node_id", "left").join(made.select(F.col("from_id").alias("node_id"), "c"), "node_id", "left")
    own = F.when(F.col("from_kind").isNull() & (F.col("value_kind") == "result"), F.col("c"))
    source = lambda f: F.when(F.col("from_kind") == "Property", F.col("from_fqn")).otherwise(F.coalesce(F.col("assigned")[f], own[f]))
    shown = F.when(F.col("from_kind") == "Property", F.concat(F.lit("promotes to "), "from_fqn")).otherwise(source("callee_name"))
    joined = lambda f: F.nullif(F.array_join(F.transform("t", lambda x: x[f]), "|"), F.lit(""))
    return out.select("node_id", "value_kind", joined("fqn").alias("type_fqn"), joined("name").alias("type_name"), source("callee_fqn").alias("source_fqn"), shown.alias("source_name"))


# --- members and what is reached through them ---


def member_references(g: Graph) -> DataFrame:
    """Per call: the member it refers to as displayed, how, and on what."""
    c = g.member_calls()
    return c.select("call_id", "callee_id", display_name(F.col("callee_kind"), F.col("callee_name")).alias("shown"), call_reference(F.col("call_kind"), F.col("callee_kind")).alias("ref_type"), "on_expr", "on_kind", F.col("call_file").alias("file"), F.col("call_line").alias("line"))


def calls_through_properties(g: Graph) -> DataFrame:
    """(property_id, class_id, call_id, callee_id, method_id): calls, by methods of a property's class, on what
    the property holds. Everything else behind a property (its USED BY below an injection, the calls that a
    contract sees) filters these rows."""
    p = _of_kind(g, "property_id", "Property").select("property_id")
    p = p.join(g.of_kind("Property").select(F.col("node_id").alias("property_id"), F.col("fqn").alias("on_symbol")), "property_id").join(_contains(g, "class_id", "property_id"), "property_id")
    c = g.calls.where("on_symbol is not null and callee_id is not null").select("call_id", "callee_id", F.col("scope_id").alias("method_id"), "on_symbol")
    c = c.join(_contains(g, "class_id", "method_id"), "method_id")
    return p.join(c, ["class_id", "on_symbol"]).select("property_id", "class_id", "call_id", "callee_id", "method_id")


def contract_calls(g: Graph) -> DataFrame:
    """(interface_id, property_id, call_id, callee_id): calls on properties of an interface's type, whose
    callee's name is one of the interface's methods'; all of them where it declares none."""
    hint = g.of_type("TYPE_HINT").select(F.col("source_id").alias("property_id"), F.col("target_id").alias("interface_id"))
    i = _of_kind(g, "interface_id", "Interface").select("interface_id")
    m = _of_kind(g, "method_id", "Method").select("method_id", "name").join(_contains(g, "interface_id", "method_id"), "method_id").select("interface_id", "name").distinct()
    some = m.select("interface_id").distinct().withColumn("declares", F.lit(True))
    names = g.ends("target", "CALLS").select(F.col("node_id").alias("callee_id"), "name")
    rows = calls_through_properties(g).join(hint, "property_id").join(i, "interface_id").join(names, "callee_id")
    rows = rows.join(some, "interface_id", "left").join(m.withColumn("named", F.lit(True)), ["interface_id", "name"], "left")
    return rows.where("declares is null or named").select("interface_id", "property_id", "call_id", "callee_id")


#: Levels that supertypes of a few classes are followed; beyond them all types are closed.
LEVELS = 32


def _supertypes(g: Graph, classes: DataFrame) -> DataFrame:
    """(class_id, ancestor_id): all that stands above classes (class_id)."""
    stored = lambda: g.inherits.select(F.col("node_id").alias("class_id"), "ancestor_id")
    if g.stores("inherits"):
        return stored()
    pairs = g.of_type("EXTENDS", "IMPLEMENTS").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("next_id"))
    start = g.keep(classes.select(F.col("class_id").alias("node_id")).distinct().join(pairs, "node_id").select(F.col("node_id").alias("root_id"), F.col("next_id").alias("node_id")).distinct(), "supertypes")
    above = expand(start, pairs, LEVELS, g.keep)
    if above.where(F.col("depth") == LEVELS).head(1):
        return stored()
    return start.union(above.select("root_id", "node_id")).toDF("class_id", "ancestor_id")


def interface_methods_of(g: Graph) -> DataFrame:
    """(method_id, interface_method_id): methods of the same name in the interfaces that a method's class, or a
    class above it, implements. Methods of one interface give each pair once, so only the pairs of those that
    stand in several are compared with each other."""
    m = _of_kind(g, "method_id", "Method").select("method_id", "name")
    own = m.join(_contains(g, "class_id", "method_id"), "method_id")
    of = m.withColumnRenamed("method_id", "interface_method_id").join(_contains(g, "interface_id", "interface_method_id"), "interface_method_id")
    of = of.join(_of_kind(g, "interface_id", "Interface").select("interface_id"), "interface_id").distinct()
    up = _supertypes(g, own.select("class_id")).withColumnRenamed("ancestor_id", "interface_id").join(of.select("interface_id").distinct(), "interface_id")
    asked = g.keep(own.join(up, "class_id").select("method_id", "interface_id", "name").distinct(), "interfaces-above")
    several = of.groupBy("interface_method_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("interface_method_id")
    by, shown = ["interface_id", "name"], ["method_id", "interface_method_id"]
    once = paired(asked, of.join(several, "interface_method_id", "left_anti"), by, "method_id", g.keep).select(*shown)
    return once.union(asked.join(of.join(several, "interface_method_id", "left_semi"), by).select(*shown).distinct())


def interface_children(g: Graph) -> DataFrame:
    """(interface_id, child_id, methods): interfaces that extend an interface, how many methods each declares,
    and how many interfaces extend it in turn."""
    i = _of_kind(g, "child_id", "Interface").select("child_id")
    e = g.of_type("EXTENDS").select(F.col("source_id").alias("child_id"), F.col("target_id").alias("interface_id")).join(i, "child_id")
    e = e.join(i.withColumnRenamed("child_id", "interface_id"), "interface_id")
    m = _of_kind(g, "method_id", "Method").select("method_id").join(_contains(g, "child_id", "method_id"), "method_id").groupBy("child_id").agg(F.count(F.lit(1)).alias("methods"))
    below = e.groupBy(F.col("interface_id").alias("child_id")).agg(F.count(F.lit(1)).alias("children"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return e.join(m, "child_id", "left").join(below, "child_id", "left").select("interface_id", "child_id", zero("methods"), zero("children"))


def supertype_members(g: Graph) -> DataFrame:
    """(class_id, member_id, how): what stands below a class's supertypes: its own overriding methods but the
    constructor, and all classes below it."""
    over = g.of_type("OVERRIDES").select(F.col("source_id").alias("member_id")).distinct()
    m = _of_kind(g, "member_id", "Method").where("name <> '__construct'").select("member_id").join(over, "member_id").join(_contains(g, "class_id", "member_id"), "member_id")
    cls = _of_kind(g, "class_id", *TYPES).select("class_id")
    below = g.subtypes.select(F.col("ancestor_id").alias("class_id"), F.col("node_id").alias("member_id")).join(cls, "class_id")
    return m.select("class_id", "member_id", F.lit("override").alias("how")).union(below.select("class_id", "member_id", F.lit("subclass"))).distinct()


def interface_uses(g: Graph) -> DataFrame:
    """Per interface: types in its methods' signatures; a parameter's type comes before a returned one."""
    i = _of_kind(g, "interface_id", "Interface").select("interface_id")
    m = _of_kind(g, "method_id", "Method").select("method_id").join(_contains(g, "interface_id", "method_id"), "method_id").join(i, "interface_id")
    hint = g.of_type("TYPE_HINT").select(F.col("source_id").alias("hinted_id"), F.col("target_id").alias("used_id"))
    a = _of_kind(g, "hinted_id", "Argument").select("hinted_id").join(_contains(g, "method_id", "hinted_id"), "hinted_id")
    rows = m.join(a, "method_id").select("interface_id", "hinted_id", F.lit("parameter_type").alias("ref_type")).union(m.select("interface_id", F.col("method_id").alias("hinted_id"), F.lit("return_type")))
    return rows.join(hint, "hinted_id").groupBy("interface_id", "used_id").agg(F.min("ref_type").alias("ref_type"))


def property_inputs(g: Graph) -> DataFrame:
    """Per promoted property: its constructor's parameter, and the calls that construct its class, with the
    argument in the parameter's name where there is one. A call comes with what it passes to such parameters, so the
    pairs of properties and calls, as many as the result has, need no join of their own."""
    p = _promoted(g).join(_contains(g, "class_id", "property_id"), "property_id")
    p = p.join(g.of_kind("Value").select(F.col("node_id").alias("parameter_id"), F.col("fqn").alias("parameter")), "parameter_id")
    p = g.keep(p, "promoted")
    calls = g.of_kind("Call").where("call_kind = 'constructor'").select(F.col("node_id").alias("call_id"))
    callee = g.of_type("CALLS").groupBy(F.col("source_id").alias("call_id")).agg(F.min("target_id").alias("callee_id"))
    made = calls.join(callee, "call_id").join(_contains(g, "class_id", "callee_id"), "callee_id").select("class_id", "call_id")
    passed = g.of_type("ARGUMENT").select(F.col("source_id").alias("call_id"), "parameter", F.col("target_id").alias("value_id"))
    passed = passed.join(p.select("parameter").distinct(), "parameter", "left_semi").groupBy("call_id", "parameter").agg(F.min("value_id").alias("value_id"))
    passed = passed.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("parameter", "value_id"))).alias("passed"))  # a call's arguments
    rows = paired(made.join(passed, "call_id", "left"), p, ["class_id"], "call_id", g.keep)
    return rows.select("property_id", "parameter_id", "call_id", F.col("passed")[F.col("parameter")].alias("value_id"))


def property_breakdown(g: Graph) -> DataFrame:
    """Per property and method: accesses, what they are made on, and the first line."""
    c = g.calls.where("callee_kind = 'Property' and scope_kind in ('Method', 'Function')")
    return c.groupBy(F.col("callee_id").alias("property_id"), F.col("scope_id").alias("method_id"), "on_expr", "on_kind").agg(F.count(F.lit(1)).alias("accesses"), F.min("call_line").alias("line"))
