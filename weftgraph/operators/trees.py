"""Ordered, limited trees of usages and dependencies, for all roots at once.

A tree depends on visiting order: a node is shown where a depth-first walk comes to it first, and the walk ends
after ``limit`` entries. What it has shown so far decides what it shows next, so no set operation gives the
tree; but a walk of limit entries looks at limit + 1 neighbours of a node at most, since each is an entry, or
was one, or is the root. So Spark orders and cuts every node's neighbours, extends all roots by joins, and
walks each root's piece, which is bounded by limit and depth whatever the graph's size, in parallel. Most walks
end among the first few lists of neighbours: a root is first given those, and more only if its walk asks for one
it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import call_reference
from ..functions.text import grams
from ..graph import Graph, stored_fact
from ..plans.expand import expand
from ..plans.replay import Entry, depth_first
from ..schema import CONTAINERS

#: How many lists of neighbours a root's walk is given at first.
LISTS = 16

TREE = "root_id string, place long, depth long, node_id string, parent_id string, loc_file string, loc_line long"


def _order(*last: str) -> list[Column]:
    return [F.asc_nulls_last("loc_file"), F.asc_nulls_last("loc_line"), *[F.col(c) for c in last]]


def _cut(df: DataFrame, key: str, most: int, *last: str) -> DataFrame:
    """The first ``most`` rows of each key; tasks cut before they shuffle."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*_order(*last)))
    return df.withColumn("k", k).where(F.col("k") <= most)


def _first(df: DataFrame, *key: str) -> DataFrame:
    """Of each key the edge whose place comes first."""
    at = F.struct(F.col("loc_file").isNull().alias("no_file"), "loc_file", F.col("loc_line").isNull().alias("no_line"), "loc_line")
    return df.groupBy(*key).agg(F.min(at).alias("at")).select(*key, "at.loc_file", "at.loc_line")


def neighbours(pairs: DataFrame, limit: int) -> DataFrame:
    """(node_id, nexts): of pairs (node_id, next_id, loc_file, loc_line) the neighbours a walk can come to, in order."""
    first = _cut(_first(pairs, "node_id", "next_id"), "node_id", limit + 1, "next_id")
    return first.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("k", "next_id", "loc_file", "loc_line"))).alias("nexts"))


def walks(near: DataFrame, starts: DataFrame, depth: int, limit: int, keep) -> DataFrame:
    """The trees (TREE) of starts (root_id, nexts) over near (node_id, nexts). In each round a root gets the lists that
    stand first by path, four times as many as before; those whose walk lacks none are done, and the last round,
    if any root comes to it, has all lists."""
    found, left, lists = None, starts, LISTS
    while depth > 1 and lists <= limit:
        tried = keep(_walked(_first_lists(near, left, depth, lists), left, depth, limit), "tree-walks")
        found = tried if found is None else found.union(tried)
        lacking = tried.where("place = 0").select("root_id")
        if not lacking.head(1):
            return found.where("place > 0")
        left, lists = keep(left.join(lacking, "root_id", "left_semi"), "tree-starts"), lists * 4
    rest = _walked(_all_lists(near, left, depth, keep), left, depth, limit)
    return (rest if found is None else found.union(rest)).where("place > 0")


def _first_lists(near: DataFrame, starts: DataFrame, depth: int, lists: int) -> DataFrame:
    """(root_id, node_id, nexts): the lists a walk comes to first, by path, of a fifth as many neighbours of the root;
    null where a node has none."""
    at = Window.partitionBy("root_id").orderBy("path")
    place = lambda p: F.col(p).cast("int")
    level = starts.select("root_id", F.posexplode(F.slice("nexts.next_id", 1, max(1, lists // 5))).alias("p", "node_id"))
    level = level.select("root_id", "node_id", F.array(place("p")).alias("path"))
    asked = level
    for _ in range(depth - 2):
        ids = near.select("node_id", F.slice("nexts.next_id", 1, lists).alias("ids"))
        down = level.join(ids, "node_id").select("root_id", "path", F.posexplode("ids").alias("p", "node_id"))
        down = down.select("root_id", "node_id", F.array_append("path", place("p")).alias("path"))
        level = down.withColumn("r", F.row_number().over(at)).where(F.col("r") <= lists).drop("r")
        asked = asked.union(level)
    asked = asked.where("node_id <> root_id").groupBy("root_id", "node_id").agg(F.min("path").alias("path"))
    asked = asked.withColumn("r", F.row_number().over(at)).where(F.col("r") <= lists).select("root_id", "node_id")
    return asked.join(near, "node_id", "left").select("root_id", "node_id", F.coalesce("nexts", F.array().cast(near.schema["nexts"].dataType)).alias("nexts"))


def _all_lists(near: DataFrame, starts: DataFrame, depth: int, keep) -> DataFrame:
    """(root_id, node_id, nexts): every list a walk can come to; null where a node has none."""
    pairs = near.select("node_id", F.explode("nexts.next_id").alias("next_id"))
    begin = starts.select("root_id", F.explode("nexts.next_id").alias("node_id")).distinct()
    reached = begin
    if depth > 2:
        reached = reached.union(expand(begin, pairs, depth - 2, keep).select("root_id", "node_id")).distinct()
    reached = reached if depth > 1 else reached.limit(0)
    asked = reached.where("node_id <> root_id").join(near, "node_id", "left")
    return asked.select("root_id", "node_id", F.coalesce("nexts", F.array().cast(near.schema["nexts"].dataType)).alias("nexts"))


def _walked(lists: DataFrame, starts: DataFrame, depth: int, limit: int) -> DataFrame:
    """The trees (TREE) of starts over their lists, or of a root that lacks one a row of place 0."""
    pieces = starts.select("root_id", F.lit(None).cast("string").alias("node_id"), "nexts").union(lists)

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = {n if isinstance(n, str) else key[0]: [(e["next_id"], e) for e in nexts] for n, nexts in zip(rows.node_id, rows.nexts)}
        out: list[tuple] = []

        def put(entries: list[Entry], parent: str) -> None:
            for e in entries:
                out.append((key[0], len(out) + 1, e.depth, e.node_id, parent, e.edge["loc_file"], e.edge["loc_line"]))
                put(e.children, e.node_id)

        try:
            put(depth_first(key[0], own.__getitem__, depth, limit), key[0])
        except KeyError:
            out = [(key[0], 0, 0, None, None, None, None)]
        shown = pd.DataFrame(out, columns=[c.split()[0] for c in TREE.split(", ")])
        return shown.astype({"place": "int64", "depth": "int64", "loc_line": "Int64"})

    return pieces.groupBy("root_id").applyInPandas(walk, TREE)


def _member_starts(g: Graph, edges: DataFrame, limit: int) -> DataFrame:
    """(root_id, nexts) of every container: the first ``limit`` edges of it and all in it, then one a neighbour."""
    roots = g.of_kind(*CONTAINERS).select(F.col("node_id").alias("root_id"))
    anc = g.above("Method", "Argument", "Function", "Property")  # what edges of use end at
    inside = anc.select(F.col("ancestor_id").alias("root_id"), "node_id").join(roots, "root_id").union(roots.select("root_id", F.col("root_id").alias("node_id")))
    every = _cut(edges.join(inside, "node_id"), "root_id", limit, "source_id", "target_id").drop("k")
    return every.select("root_id", "next_id", "loc_file", "loc_line", "source_id", "target_id")


def uses_trees(g: Graph, up: bool, depth: int = 3, limit: int = 100) -> DataFrame:
    """Per container that is used (or, up, uses anything): the tree of its users (of what it uses), members' edges at
    the top, as rows by place. A missing place sorts last; of several edges to a neighbour the first counts."""
    node, other = ("source_id", "target_id") if up else ("target_id", "source_id")
    uses = g.of_type("USES").select(F.col(node).alias("node_id"), F.col(other).alias("next_id"), "loc_file", "loc_line", "source_id", "target_id")
    near = g.keep(neighbours(uses, limit), "neighbours")
    top = _member_starts(g, uses, limit)
    seat = F.row_number().over(Window.partitionBy("root_id").orderBy(*_order("source_id", "target_id")))
    again = Window.partitionBy("root_id", "next_id").orderBy("k")
    top = top.withColumn("k", seat).withColumn("again", F.row_number().over(again)).where("again = 1")
    starts = g.keep(top.groupBy("root_id").agg(F.sort_array(F.collect_list(F.struct("k", "next_id", "loc_file", "loc_line"))).alias("nexts")), "tree-starts")
    return walks(near, starts, depth, limit, g.keep)


# --- execution flow: what a method's calls do, call by call ---


@stored_fact
def flow_entries(g: Graph) -> DataFrame:
    """(scope_id, k, call_id, callee_id, local_id, ref_type, orphan, call_file, call_line): the calls a method's flow shows, in the order of their
    ids: of each callee the first; none whose result is the receiver or an argument of another call of the method. An
    orphan is a property access that an argument of the flow's calls already spells out: counted, but not shown."""
    c = g.calls.where("scope_kind in ('Method', 'Function')")
    scope = c.select("call_id", "scope_id")
    made = g.of_type("PRODUCES").select(F.col("source_id").alias("call_id"), F.col("target_id").alias("value_id"))
    made = made.join(g.nodes.where("value_kind = 'result'").select(F.col("node_id").alias("value_id")), "value_id").join(scope, "call_id")
    used = g.of_type("RECEIVER", "ARGUMENT").select(F.col("target_id").alias("value_id"), F.col("source_id").alias("by"))
    used = used.join(scope.toDF("by", "scope_id"), "by")
    consumed = made.join(used, ["value_id", "scope_id"]).where("call_id <> by").select("call_id").distinct()
    c = c.join(consumed, "call_id", "left_anti")
    again = F.row_number().over(Window.partitionBy("scope_id", F.coalesce("callee_id", "call_id")).orderBy("call_id"))
    c = c.withColumn("again", again).where("again = 1").withColumn("k", F.row_number().over(Window.partitionBy("scope_id").orderBy("call_id")))
    c = g.keep(c.withColumn("ref_type", call_reference(F.col("call_kind"), F.col("callee_kind"))), "flow-calls")
    name = F.regexp_extract("callee_fqn", r"::\$(.*)\z", 1)
    read = c.where("ref_type = 'property_access' and local_id is null and on_expr is not null").withColumn("name", name).where("name <> ''")
    read = read.select("call_id", "scope_id", F.concat("on_expr", F.lit("->"), "name").alias("text"))
    read = read.withColumn("gram", F.col("text").substr(F.length("text") - 2, F.lit(3)))  # four characters at least
    said = g.args.where("expression is not null").select("call_id", "expression").join(c.select("call_id", "scope_id"), "call_id").select("scope_id", "expression").distinct()
    said = said.withColumn("gram", F.explode(grams(F.col("expression"), 3)))
    orphan = read.join(said, ["scope_id", "gram"]).where("contains(expression, text)").select("call_id").distinct().withColumn("orphan", F.lit(True))
    return c.join(orphan, "call_id", "left").select("scope_id", "k", "call_id", "callee_id", "local_id", "ref_type", F.coalesce("orphan", F.lit(False)).alias("orphan"), "call_file", "call_line")


def execution_trees(g: Graph, depth: int = 3, limit: int = 100) -> DataFrame:
    """(root_id, place, depth, parent_id, call_id, callee_id, local_id, ref_type): for every method and function its flow, the
    calls of what it calls below, to ``depth``. A path never comes to a callee twice, nor back to its root; the count of
    ``limit`` entries is shared by a whole tree.

    Nothing else is shared, so an entry's place is its rank among all paths: paths are arrays of places, compared
    place by place. Of a level a root keeps the first ``limit`` paths, as no later one can have a place up to limit.
    Nor can a path with too many below those before it: each of these has as many entries as its callee's flow, but
    for at most one for each callee on the path."""
    e = flow_entries(g)
    many = e.groupBy(F.col("scope_id").alias("callee_id")).agg(F.count(F.lit(1)).alias("below"))
    e = g.keep(e.drop("call_file", "call_line").join(many, "callee_id", "left"), "flow-below") if depth > 1 else e.withColumn("below", F.lit(0).cast("long"))
    at = Window.partitionBy("root_id").orderBy("path")
    shown = ["call_id", "callee_id", "local_id", "ref_type", "orphan", "below"]
    least = F.greatest(F.coalesce("below", F.lit(0)) - F.size("seen") - 1, F.lit(0))
    ahead = F.coalesce(F.sum(least).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unseen = lambda seen: F.col("callee_id").isNull() | ~F.array_contains(seen, F.col("callee_id"))
    level = e.withColumnRenamed("scope_id", "root_id").withColumns({"path": F.array("k"), "seen": F.array("root_id"), "parent_id": F.lit(None).cast("string")})
    level = level.where(unseen("seen")).select("root_id", "path", "seen", "parent_id", *shown)
    found, n = None, 1
    while True:
        level = level.withColumn("r", F.row_number().over(at)).where(F.col("r") <= limit)
        if n < depth:
            level = level.withColumn("r", F.col("r") + ahead).where(F.col("r") <= limit)
        else:
            level = level.drop("seen")
        level = g.keep(level, "flow-level")
        part = level.select("root_id", "path", "parent_id", *shown[:-1])
        found = part if found is None else found.union(part)
        if n == depth or not level.head(1):
            break
        up = level.where((F.col("r") < limit) & F.col("below").isNotNull()).select("root_id", "path", F.array_append("seen", F.col("callee_id")).alias("seen"), F.col("call_id").alias("parent_id"), F.col("callee_id").alias("scope_id"))
        below = up.join(e, "scope_id").where(unseen("seen"))
        level, n = below.select("root_id", F.array_append("path", F.col("k")).alias("path"), "seen", "parent_id", *shown), n + 1
    out = found.withColumn("place", F.row_number().over(at).cast("long")).where((F.col("place") <= limit) & ~F.col("orphan"))
    return out.select("root_id", "place", F.size("path").cast("long").alias("depth"), "parent_id", "call_id", "callee_id", "local_id", "ref_type")
