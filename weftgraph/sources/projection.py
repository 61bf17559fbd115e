"""The star schema as a property graph, so that every operator runs on tables of any size.

region, nation, customer, supplier, part, orders and lineitem become files, classes and functions, methods
and their arguments, properties and the parameters they are promoted from, types of all kinds, calls and
values; events become flows, messages and events; embeddings become vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_COLUMNS = ["node_ord", "node_id", "kind", "name", "fqn", "file", "start_line", "call_kind", "value_kind"]
EDGE_COLUMNS = ["type", "source_id", "target_id", "loc_file", "loc_line", "position", "expression", "parameter"]

_CLASSES = ["Class", "Interface", "Trait", "Enum"]
#: The kinds of nodes that stand at the source and at the target of each type of edge.
EDGES_OF = {
    "CONTAINS": (["File", *_CLASSES, "Method"], ["Method", "Function", "Property", "Argument", "Value", "Call", *_CLASSES]),
    "USES": (["Method", "Argument"], ["Method", "Function", "Property", *_CLASSES]),
    "TYPE_HINT": (["Method", "Property", "Argument"], _CLASSES),
    "TYPE_OF": (["Value"], _CLASSES),
    "CALLS": (["Call"], ["Method", "Function", "Property"]),
    "RECEIVER": (["Call"], ["Value"]),
    "ARGUMENT": (["Call"], ["Value"]),
    "PRODUCES": (["Call"], ["Value"]),
    "ASSIGNED_FROM": (["Property", "Value"], ["Value"]),
    "EXTENDS": (_CLASSES, _CLASSES),
    "IMPLEMENTS": (_CLASSES, _CLASSES),
    "USES_TRAIT": (_CLASSES, _CLASSES),
    "OVERRIDES": (["Method"], ["Method"]),
}


def _rows(df: DataFrame, columns: list[str], **values: Column) -> DataFrame:
    kinds = {"node_ord": "long", "start_line": "long", "loc_line": "long", "position": "long"}
    return df.select(*[values.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns])


class Projection:
    """Lazy DataFrames over one directory of Parquet tables. keep(df, name) stores what many of them read."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df):
        self.spark, self.keep = spark, keep
        self._edges_of: dict[str, DataFrame] = {}
        self.table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cached_property
    def sizes(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("supplier", "customer", "part", "orders")}

    def values(self) -> DataFrame:
        return self._values

    @cached_property
    def _values(self) -> DataFrame:
        """lineitem, numbered within its order by the whole row, with the flag of the row before and the orders of its
        key (one, where keys are unique): edges of values need no join of their own."""
        l = self.table("lineitem")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        by = Window.partitionBy("l_orderkey").orderBy(*order)
        l = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.row_number().over(by).cast("long").alias("rn"), F.lag("l_returnflag").over(by).alias("flag_before"))
        o = self.orders().groupBy("o_orderkey").agg(F.collect_list(F.struct("o_custkey", "callee_id")).alias("of"))
        return self.keep(l.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey"), "values")

    def classes(self) -> DataFrame:
        r = self.table("region")
        n = self.table("nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select("n_nationkey", "n_name", "r_name", F.concat(F.lit("App\\"), "r_name", F.lit("\\"), "n_name").alias("fqn"))

    def nodes(self, *kinds: str) -> DataFrame:
        """Nodes of these kinds, or all. Values are numbered and stored only where they are asked for."""
        key = lambda p, c: F.concat(F.lit(p), F.col(c))
        php = lambda c: F.concat(F.col(c), F.lit(".php"))
        pick = lambda test, a, b: F.when(test, F.lit(a)).otherwise(F.lit(b))
        cls = F.broadcast(self.classes())
        parts = [_rows(self.table("region"), NODE_COLUMNS, node_ord=F.col("r_regionkey"), node_id=key("r:", "r_regionkey"), kind=F.lit("File"), name=F.col("r_name"), fqn=F.col("r_name"), file=php("r_name"), start_line=F.lit(0))]
        parts.append(_rows(self.classes(), NODE_COLUMNS, node_ord=F.lit(100000000) + F.col("n_nationkey"), node_id=key("n:", "n_nationkey"), kind=pick(F.col("n_nationkey") % 5 == 4, "Interface", "Class"), name=F.col("n_name"), fqn=F.col("fqn"), file=php("r_name"), start_line=F.col("n_nationkey")))
        name = F.when(F.col("c_custkey") % 10 == 0, "__construct").otherwise(F.col("c_name"))
        parts.append(_rows(self.table("customer").join(cls, F.col("c_nationkey") == F.col("n_nationkey")), NODE_COLUMNS, node_ord=F.lit(200000000) + F.col("c_custkey"), node_id=key("c:", "c_custkey"), kind=F.lit("Method"), name=name, fqn=F.concat("fqn", F.lit("::"), name, F.lit("()")), file=php("r_name"), start_line=F.col("c_custkey")))
        prop = F.concat(F.lit("$"), "s_name")
        parts.append(_rows(self.table("supplier").join(cls, F.col("s_nationkey") == F.col("n_nationkey")), NODE_COLUMNS, node_ord=F.lit(300000000) + F.col("s_suppkey"), node_id=key("s:", "s_suppkey"), kind=F.lit("Property"), name=prop, fqn=F.concat("fqn", F.lit("::"), prop), file=php("r_name"), start_line=F.col("s_suppkey")))
        type_kind = F.when(F.col("p_size") <= 5, "Interface").when(F.col("p_size") == 6, "Trait").when(F.col("p_size") == 7, "Enum").otherwise("Class")
        parts.append(_rows(self.table("part"), NODE_COLUMNS, node_ord=F.lit(400000000) + F.col("p_partkey"), node_id=key("p:", "p_partkey"), kind=type_kind, name=F.col("p_name"), fqn=F.concat(F.lit("App\\"), "p_brand", F.lit("\\"), "p_name", F.lit("_"), F.col("p_partkey")), file=php("p_brand"), start_line=F.col("p_partkey")))
        function = F.concat(F.lit("fn_"), "n_name")
        parts.append(_rows(self.classes(), NODE_COLUMNS, node_ord=F.lit(150000000) + F.col("n_nationkey"), node_id=key("f:", "n_nationkey"), kind=F.lit("Function"), name=function, fqn=F.concat(F.lit("App\\"), function), file=php("r_name"), start_line=F.col("n_nationkey")))
        taker = self.table("customer").where("c_custkey % 4 = 0").join(cls, F.col("c_nationkey") == F.col("n_nationkey"))
        parts.append(_rows(taker, NODE_COLUMNS, node_ord=F.lit(600000000) + F.col("c_custkey"), node_id=key("a:", "c_custkey"), kind=F.lit("Argument"), name=F.lit("$p0"), fqn=F.concat("fqn", F.lit("::"), name, F.lit("().$p0")), file=php("r_name"), start_line=F.col("c_custkey")))
        given = self.table("supplier").where("s_suppkey % 3 = 0").join(cls, F.col("s_nationkey") == F.col("n_nationkey"))
        parts.append(_rows(given, NODE_COLUMNS, node_ord=F.lit(700000000) + F.col("s_suppkey"), node_id=key("w:", "s_suppkey"), kind=F.lit("Value"), name=prop, fqn=F.concat("fqn", F.lit("::__construct()."), prop), file=php("r_name"), start_line=F.col("s_suppkey"), value_kind=F.lit("parameter")))
        # the parameter that arguments named <method>.$p0 go to
        parts.append(_rows(taker, NODE_COLUMNS, node_ord=F.lit(800000000) + F.col("c_custkey"), node_id=key("q:", "c_custkey"), kind=F.lit("Value"), name=F.lit("$p0"), fqn=F.concat(F.lit("c:"), F.col("c_custkey"), F.lit(".$p0")), file=php("r_name"), start_line=F.col("c_custkey"), value_kind=F.lit("parameter")))
        fifth, sixth = F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 6 == 0
        kind = F.when(F.col("o_orderstatus") == "F", F.when(fifth, "method_static").otherwise("method"))
        kind = kind.when(F.col("o_orderstatus") == "O", F.when(sixth, "function").otherwise("constructor")).otherwise(F.when(fifth, "access_static").otherwise("access"))
        call = key("call", "o_orderkey")
        parts.append(_rows(self.table("orders"), NODE_COLUMNS, node_ord=F.lit(500000000) + F.col("o_orderkey"), node_id=key("o:", "o_orderkey"), kind=F.lit("Call"), name=call, fqn=call, file=F.col("o_orderpriority"), start_line=F.col("o_orderkey") % 1000, call_kind=kind))
        vkind = F.when(F.col("l_returnflag") == "A", "parameter").when(F.col("l_returnflag") == "N", "local").otherwise("result")
        if not kinds or "Value" in kinds:
            parts.append(_rows(self.values(), NODE_COLUMNS, node_ord=F.lit(1000000000) + F.col("l_orderkey") * 1000 + F.col("rn"), node_id=_value(), kind=F.lit("Value"), name=key("$v", "rn"), fqn=F.concat(F.lit("call"), F.col("l_orderkey"), F.lit("::$v"), F.col("rn")), start_line=F.col("rn"), value_kind=vkind))
        return _union(parts).where(F.col("kind").isin(*kinds)) if kinds else _union(parts)

    def orders(self) -> DataFrame:
        """orders with the node each calls: properties of even numbers, functions, methods."""
        o, n = self.table("orders"), self.sizes
        access = F.concat(F.lit("s:"), F.col("o_orderkey") % (n["supplier"] // 2) * 2)
        function = (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 6 == 0)
        callee = F.when(F.col("o_orderstatus") == "P", access).when(function, F.concat(F.lit("f:"), F.col("o_orderkey") % 25)).otherwise(F.concat(F.lit("c:"), F.col("o_orderkey") % n["customer"]))
        return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", callee.alias("callee_id"))

    def edges(self) -> DataFrame:
        return _union([self.edges_of(t) for t in EDGES_OF])

    def edges_of(self, kind: str) -> DataFrame:
        """The edges of one type. Those without an id at either end are none."""
        if kind not in self._edges_of:
            found = self._made(kind, getattr(self, f"_{kind.lower()}")())
            self._edges_of[kind] = self.keep(found, "uses") if kind == "USES" else found
        return self._edges_of[kind]

    @staticmethod
    def _made(kind: str, tables: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
        found = _union([_rows(df, EDGE_COLUMNS, type=F.lit(kind), **v) for df, v in tables])
        return found.where("source_id is not null and target_id is not null")

    def contained(self, *kinds: str) -> DataFrame:
        """The CONTAINS edges of nodes of these kinds, each of which has one container."""
        return self._made("CONTAINS", [table for kind, *table in self._containers(*kinds) if kind in kinds])

    def _of_order(self) -> DataFrame:
        return self.values().select("*", F.inline("of")).drop("of")

    def _lines(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        return line.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def _takers(self) -> DataFrame:
        return self.table("customer").where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_custkey") * 7 % self.sizes["part"]).alias("hint"))

    def _given(self) -> DataFrame:
        return self.table("supplier").where("s_suppkey % 3 = 0")

    def _contains(self):
        return [table for _, *table in self._containers()]

    def _containers(self, *kinds: str) -> list[tuple]:
        """By kind of what is contained; lineitem's values only if asked for, or all are."""
        nation, method = self.table("nation"), _key("c:", "o_custkey")
        values = [] if kinds and "Value" not in kinds else [("Value", self._of_order(), {"source_id": method, "target_id": _value()})]
        return values + [
            ("Class", nation, {"source_id": _key("r:", "n_regionkey"), "target_id": _key("n:", "n_nationkey")}),
            ("Method", self.table("customer"), {"source_id": _key("n:", "c_nationkey"), "target_id": _key("c:", "c_custkey")}),
            ("Property", self.table("supplier"), {"source_id": _key("n:", "s_nationkey"), "target_id": _key("s:", "s_suppkey")}),
            ("Call", self.table("orders"), {"source_id": method, "target_id": _key("o:", "o_orderkey")}),
            ("Function", nation, {"source_id": _key("r:", "n_regionkey"), "target_id": _key("f:", "n_nationkey")}),
            ("Argument", self._takers(), {"source_id": _key("c:", "c_custkey"), "target_id": _key("a:", "c_custkey")}),
            ("Value", self._takers(), {"source_id": _key("c:", "c_custkey"), "target_id": _key("q:", "c_custkey")}),
        ]

    def _type_hint(self):
        n = self.sizes["part"]
        return [
            (self._takers(), {"source_id": _key("a:", "c_custkey"), "target_id": _key("p:", "hint")}),
            (self.table("supplier"), {"source_id": _key("s:", "s_suppkey"), "target_id": _key("p:", F.col("s_suppkey") % n)}),
            (self.table("customer"), {"source_id": _key("c:", "c_custkey"), "target_id": _key("p:", F.col("c_custkey") % n)}),
        ]

    def _type_of(self):
        return [
            (self._takers(), {"source_id": _key("q:", "c_custkey"), "target_id": _key("p:", "hint")}),
            (self._given(), {"source_id": _key("w:", "s_suppkey"), "target_id": _key("p:", F.col("s_suppkey") % self.sizes["part"])}),
            (self.values(), {"source_id": _value(), "target_id": _key("p:", "l_partkey")}),
        ]

    def _uses(self):
        """Pairs are grouped by their numbers, before they become ids. They need no place in the order, so rows of lineitem
        aren't numbered for them."""
        method, of_order = _key("c:", "o_custkey"), self._lines()
        s = of_order.where("l_suppkey % 2 = 1").groupBy("o_custkey", "l_suppkey").agg(F.min("l_orderkey").alias("line"))
        p = of_order.groupBy("o_custkey", "l_partkey").agg(F.min("l_orderkey").alias("line"))
        c = self.orders().groupBy("o_custkey", "callee_id").agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("first"))
        file = F.concat(F.lit("f"), F.col("l_suppkey") % 7)
        return [
            (self._takers(), {"source_id": _key("a:", "c_custkey"), "target_id": _key("p:", "hint"), "loc_file": F.lit("arg"), "loc_line": F.col("c_custkey")}),
            (s, {"source_id": method, "target_id": _key("s:", "l_suppkey"), "loc_file": F.when(F.col("l_suppkey") % 3 != 0, file), "loc_line": F.col("line")}),
            (p, {"source_id": method, "target_id": _key("p:", "l_partkey"), "loc_file": F.concat(F.lit("f"), F.col("l_partkey") % 7), "loc_line": F.col("line")}),
            (c, {"source_id": method, "target_id": F.col("callee_id"), "loc_file": F.col("first.o_orderpriority"), "loc_line": F.col("first.o_orderkey") % 1000}),
        ]

    def _calls(self):
        return [(self.orders(), {"source_id": _key("o:", "o_orderkey"), "target_id": F.col("callee_id")})]

    def _receiver(self):
        return [(self.values().where("rn = 1"), {"source_id": _key("o:", "l_orderkey"), "target_id": _value()})]

    def _produces(self):
        return [(self.values().where("l_returnflag = 'R'"), {"source_id": _key("o:", "l_orderkey"), "target_id": _value()})]

    def produced(self, *types: str) -> DataFrame:
        """The PRODUCES edges, those of receivers if no others are asked for: the first values of calls."""
        made = [(df.where("rn = 1") if types == ("RECEIVER",) else df, ids) for df, ids in self._produces()]
        return self._made("PRODUCES", made)

    def _argument(self):
        given = lambda at, shown, name: {"position": at, "expression": shown, "parameter": F.concat("callee_id", F.lit(".$p"), name)}
        order, shown = _key("o:", "o_orderkey"), _key("$v", "rn")
        handed = self.orders().where("o_custkey % 4 = 0 and o_orderkey % 3 = 0")
        made = self.values().where("l_returnflag = 'R' and l_orderkey % 4 = 0").select("l_orderkey", "rn").join(self.orders().where("o_orderkey % 4 = 1"), F.col("l_orderkey") + 1 == F.col("o_orderkey"))
        late = F.lit(50) + F.col("rn")
        return [
            (handed, {"source_id": order, "target_id": _key("q:", "o_custkey")} | given(F.lit(40), F.lit("$p0"), F.lit("0"))),
            (self._of_order(), {"source_id": _key("o:", "l_orderkey"), "target_id": _value()} | given(F.col("rn") - 1, shown, F.col("rn") - 1)),
            (made, {"source_id": order, "target_id": _value()} | given(late, shown, late)),
        ]

    def _assigned_from(self):
        local = self.values().where("l_returnflag = 'N' and flag_before = 'R'")
        return [
            (self._given(), {"source_id": _key("s:", "s_suppkey"), "target_id": _key("w:", "s_suppkey")}),
            (local, {"source_id": _value(), "target_id": F.concat(F.lit("v:"), F.col("l_orderkey"), F.lit(":"), F.col("rn") - 1)}),
        ]

    def _extends(self):
        return [(self.table("part").where("p_partkey > 0"), {"source_id": _key("p:", "p_partkey"), "target_id": _key("p:", _heap("p_partkey"))})]

    def _first_of_brand(self, parts: str, first: str) -> DataFrame:
        part = self.table("part")
        least = part.where(first).groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("k"))
        return part.where(parts).join(F.broadcast(least), F.col("p_brand") == F.col("brand"))

    def _implements(self):
        nation = F.col("n_nationkey")
        return [
            (self._first_of_brand("p_size > 5", "p_size <= 5"), {"source_id": _key("p:", "p_partkey"), "target_id": _key("p:", "k")}),
            (self.table("nation").where("n_nationkey % 5 <> 4"), {"source_id": _key("n:", nation), "target_id": _key("n:", nation - nation % 5 + 4)}),
        ]

    def _uses_trait(self):
        return [(self._first_of_brand("p_size > 7 and p_partkey % 3 = 0", "p_size = 6"), {"source_id": _key("p:", "p_partkey"), "target_id": _key("p:", "k")})]

    def _overrides(self):
        return [(self.table("customer").where("c_custkey > 0"), {"source_id": _key("c:", "c_custkey"), "target_id": _key("c:", _heap("c_custkey"))})]

    def flows(self) -> DataFrame:
        customers = self.sizes["customer"]
        kind = F.when(F.col("user_id") % 4 == 0, "http").when(F.col("user_id") % 4 == 1, "message").when(F.col("user_id") % 4 == 2, "event").otherwise("cli")
        u = self.table("events").select("user_id").distinct()
        return u.select(F.concat(F.lit("flow:"), kind, F.lit(":"), F.col("user_id")).alias("flow_id"), kind.alias("type"), "user_id", F.concat(F.lit("n:"), F.col("user_id") % 25).alias("class_node_id"), F.concat(F.lit("c:"), F.col("user_id") % customers).alias("method_node_id"))

    def emits(self) -> DataFrame:
        """One row per event: the flow that emits it, and from which call."""
        orders = self.sizes["orders"]
        event = F.col("event_type").isin("purchase", "error")
        e = self.table("events").select("user_id", "event_id", "event_type", "props").join(self.flows().select("user_id", "flow_id"), "user_id")
        label = F.when(event, "Event").otherwise("Message")
        to = F.concat(F.when(event, "event:").otherwise("message:"), "event_type")
        return e.select("flow_id", label.alias("to_label"), to.alias("to_id"), F.concat(F.lit("o:"), F.col("event_id") % orders).alias("call_node_id"), "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))

    def handled_by(self) -> DataFrame:
        """Which flows handle a message or event: those whose number ends as the id's length does."""
        names = self.emits().select("to_label", "to_id").distinct().withColumn("digit", (F.length("to_id") % 10).cast("long"))
        flows = self.flows().withColumn("digit", F.col("user_id") % 10)
        both = flows.join(F.broadcast(names), "digit")  # one name per kind of event
        return both.select(F.col("to_label").alias("from_label"), F.col("to_id").alias("from_id"), "flow_id", (F.col("user_id") % 5).alias("priority")).distinct()

    def vectors(self) -> DataFrame:
        v = F.col("vec_id") % 3
        name = F.when(v == 0, "code_embeddings").when(v == 1, "explain_embeddings").otherwise("flow_explain_embeddings")
        return self.table("embeddings").select("vec_id", name.alias("collection"), F.concat(F.lit("p:"), F.col("vec_id") % 100).alias("node_id"), "embedding")


def _key(prefix: str, number: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(number) if isinstance(number, str) else number).cast("string"))


def _heap(key: str) -> Column:
    return F.floor((F.col(key) - 1) / 2.0).cast("long")


def _value() -> Column:
    return F.concat(F.lit("v:"), F.col("l_orderkey"), F.lit(":"), F.col("rn"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
