"""Which call stands behind a reference: the nearest by line, as an as-of join.

Both sides are sorted together once per key, and each reference takes the last call before it and the first
after it: rows grow with references plus calls, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


def as_of(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left (keys, line, ...) with the hit of right (keys, line, hit) whose line is nearest, and how far off it is; of
    several the least hit. Rows of left without any are dropped."""
    rest = [c for c in left.columns if c not in [*keys, "line"]]
    row = F.struct(*[F.col(c) for c in rest])
    asked = left.select(*keys, "line", row.alias("row"), F.lit(None).cast(right.schema["hit"].dataType).alias("hit"), F.lit(1).alias("side"))
    there = right.groupBy(*keys, "line").agg(F.min("hit").alias("hit"))
    there = there.select(*keys, "line", F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "hit", F.lit(0).alias("side"))
    found = F.when(F.col("side") == 0, F.struct("line", "hit"))

    def running(line: Column) -> Column:
        by = Window.partitionBy(*keys).orderBy(line, "side").rowsBetween(Window.unboundedPreceding, 0)
        return F.last(found, ignorenulls=True).over(by)

    both = asked.unionByName(there).withColumn("before", running(F.asc("line"))).withColumn("after", running(F.desc("line"))).where("side = 1")
    near = [F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.line") - F.col("line")).alias("off"), F.col(f"{s}.hit").alias("hit"))) for s in ("before", "after")]
    both = both.withColumn("near", F.least(*near)).where("near is not null")
    return both.select(*keys, "line", *[F.col(f"row.{c}").alias(c) for c in rest], F.col("near.hit").alias("hit"), F.col("near.off").alias("off"))


#: Kinds that a call can end at.
CALLED = "Method", "Function", "Property"


def _inside(g: Graph) -> DataFrame:
    """(source_id, call_id): calls and what contains them, of that what can use anything."""
    call = g.sites.select(F.col("call_id").alias("node_id"))
    user = g.ends("source", "USES").select(F.col("node_id").alias("ancestor_id"))
    return g.above("Call").join(user, "ancestor_id", "left_semi").join(call, "node_id").select(F.col("ancestor_id").alias("source_id"), F.col("node_id").alias("call_id"))


def nearest_call(g: Graph) -> DataFrame:
    """(source_id, target_id, loc_file, loc_line, strategy, call_id, off) of each place of use with a call behind it, by the
    first strategy that finds any: 1 a call of the target inside the source; 2 a call of the target in the same
    file; 3 a constructor call inside the source, where the target is the constructed class. Of several the
    nearest by line, then the least id. A place without file or line takes the source's own. Uses of what no call
    could stand behind are left out first: most are of types."""
    line = F.coalesce("call_line", F.lit(0))
    c = g.sites.where("callee_id is not null").select("call_id", F.col("callee_id").alias("target_id"), F.col("call_file").alias("file"), line.alias("line"), "call_line", "call_kind", "callee_name")
    holds = g.containing(*CALLED).select(F.col("source_id").alias("class_id"), F.col("target_id").alias("ctor_id"))
    constructing = c.where("call_kind = 'constructor' and callee_name = '__construct'").join(holds, F.col("target_id") == F.col("ctor_id"))
    behind = c.select("target_id").union(constructing.select("class_id")).distinct()
    n = g.ends("source", "USES").select(F.col("node_id").alias("source_id"), "file", "start_line")
    r = g.of_type("USES").select("source_id", "target_id", "loc_file", "loc_line").join(behind, "target_id", "left_semi").distinct().join(n, "source_id")
    r = r.select("source_id", "target_id", "loc_file", "loc_line", F.coalesce("loc_file", "file").alias("file"), F.coalesce("loc_line", "start_line").alias("at"))
    r = r.withColumn("line", F.coalesce("at", F.lit(0)))
    inside = _inside(g)
    own = inside.join(c, "call_id").select("source_id", "target_id", "line", F.col("call_id").alias("hit"))
    same = c.where("file is not null and call_line is not null").select("target_id", "file", "line", F.col("call_id").alias("hit"))
    built = inside.join(constructing, "call_id").select("source_id", F.col("class_id").alias("target_id"), "line", F.col("call_id").alias("hit"))
    keys = ["source_id", "target_id"]
    found = [
        as_of(r, own, keys).withColumn("strategy", F.lit(1)),
        as_of(r.where("file is not null and at is not null"), same, ["target_id", "file"]).withColumn("strategy", F.lit(2)),
        as_of(r, built, keys).withColumn("strategy", F.lit(3)),
    ]
    shown = [f.select(*keys, "loc_file", "loc_line", "strategy", "hit", "off") for f in found]
    place = [*keys, "loc_file", "loc_line"]
    best = shown[0].union(shown[1]).union(shown[2]).groupBy(*place).agg(F.min(F.struct("strategy", "off", "hit")).alias("b"))
    return best.select(*place, F.col("b.strategy").cast("long").alias("strategy"), F.col("b.hit").alias("call_id"), F.col("b.off").cast("long").alias("off"))


def best_receiver(g: Graph) -> DataFrame:
    """(class_id, caller_id, property_id, loc_line, receiver, receiver_kind, through): for each use of a property by a
    method or function outside its class, on what it is read: of the caller's accesses those on the line of
    the use come first, then by id; each column takes its first that there is."""
    holds = g.of_type("CONTAINS").select(F.col("source_id").alias("class_id"), F.col("target_id").alias("property_id"))
    prop = g.of_kind("Property").select(F.col("node_id").alias("property_id"))
    caller = g.of_kind("Method", "Function").select(F.col("node_id").alias("caller_id"))
    r = g.of_type("USES").select(F.col("source_id").alias("caller_id"), F.col("target_id").alias("property_id"), "loc_line").distinct()
    r = r.join(prop, "property_id").join(caller, "caller_id").join(holds, "property_id")
    r = r.join(g.above("Method", "Function").select(F.col("node_id").alias("caller_id"), F.col("ancestor_id").alias("class_id")), ["caller_id", "class_id"], "left_anti")
    c = g.calls.where("callee_kind = 'Property'").select(F.col("scope_id").alias("caller_id"), F.col("callee_id").alias("property_id"), "call_id", "call_line", "receiver_name", "receiver_value_kind", "on_symbol")
    c = r.join(c, ["caller_id", "property_id"], "left").withColumn("exact", F.coalesce(F.when(F.col("call_line") == F.col("loc_line"), 0), F.lit(1)))

    def first(column: str) -> Column:
        return F.min(F.when(F.col(column).isNotNull(), F.struct("exact", "call_id", F.col(column).alias("x"))))["x"]

    return c.groupBy("class_id", "caller_id", "property_id", "loc_line").agg(first("receiver_name").alias("receiver"), first("receiver_value_kind").alias("receiver_kind"), first("on_symbol").alias("through"))
