"""Every query by name: a function of the stored graph, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import ProjectedGraph, endpoints, projected
from .functions.classify import REGISTERED, call_reference
from .functions.text import display_name, line_range, method_fqn, parameter_name
from .operators import context as C
from .operators import definition as D
from .operators import flows as W
from .operators import reconcile as R
from .operators import search as V
from .operators import symbols as S
from .operators import texts as X
from .oracle import sql

QUERIES: dict[str, Callable[[ProjectedGraph], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f: Callable[[ProjectedGraph], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def _n(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


_ORDER = "loc_file NULLS LAST, loc_line NULLS LAST, source_id, target_id"
_TYPES = "('Class', 'Interface', 'Trait', 'Enum')"
_SEARCH = "kind IN ('Class', 'Interface', 'Trait', 'Enum', 'Method', 'Function', 'Property', 'Const', 'EnumCase', 'File')"

# --- import ---

query("kind_counts", sql("SELECT kind, count(*) AS n FROM g_nodes GROUP BY kind", "g_nodes"))(lambda g: _n(g.nodes, "kind"))
query("type_counts", sql("SELECT type, count(*) AS n FROM g_edges GROUP BY type", "g_edges"))(lambda g: _n(g.edges, "type"))


@query("import_validate", sql("""
SELECT 'nodes' AS what, count(*) AS rows, count(DISTINCT node_id) AS keys FROM g_nodes
UNION ALL SELECT 'edges', count(*), count(DISTINCT concat(type, '|', source_id, '|', target_id)) FROM g_edges""", "g_nodes", "g_edges"))  # fmt: skip
def _validate(g):
    one = lambda what, df, key: df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys")).select(F.lit(what).alias("what"), "rows", "keys")
    return one("nodes", g.nodes, F.col("node_id")).union(one("edges", g.edges, F.concat_ws("|", "type", "source_id", "target_id")))


@query("contains_ordinal", sql("SELECT source_id, target_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY target_id) - 1 AS BIGINT) AS ordinal FROM g_edges WHERE type = 'CONTAINS'", "g_edges"))
def _ordinal(g):
    from .sources.documents import contains_ordinal

    return contains_ordinal(g.of_type("CONTAINS"), "target_id").select("source_id", "target_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("edge_endpoint_filter", sql("""SELECT e.type, count(*) AS n FROM g_edges e JOIN g_nodes s ON s.node_id = e.source_id AND s.kind <> 'Interface'
JOIN g_nodes t ON t.node_id = e.target_id AND t.kind <> 'Interface' GROUP BY e.type""", "g_nodes", "g_edges"))  # fmt: skip
def _endpoints(g):
    return _n(endpoints(g.edges, g.nodes.where("kind <> 'Interface'")), "type")


# --- symbols ---


def _stage_sql(q: str) -> str:
    short = q.split("::")[-1]
    bare = short.rstrip("()")
    e = q.replace("'", "''")
    return f"""SELECT '{e}' AS query, node_id, kind, fqn, stage FROM (
SELECT *, min(stage) OVER () AS best FROM (SELECT node_id, kind, fqn, node_ord, CAST(CASE WHEN fqn = '{e}' THEN 1 WHEN lower(fqn) = lower('{e}') THEN 2 WHEN ends_with(fqn, '{e}') AND {_SEARCH} THEN 3
WHEN name = '{short}' AND {_SEARCH} THEN 4 WHEN name = '{bare}' AND '{bare}' <> '{short}' AND {_SEARCH} THEN 5 WHEN contains(fqn, '{e}') AND {_SEARCH} THEN 6 END AS BIGINT) AS stage FROM g_nodes) WHERE stage IS NOT NULL)
WHERE stage = best QUALIFY stage <= 2 OR row_number() OVER (ORDER BY node_ord) <= 50"""


def _resolve(*queries: str):
    return lambda g: S.resolve_many(g, list(queries)).select("query", "node_id", "kind", "fqn", "stage")


_CASCADE = ["App\\AFRICA\\NATION_0", "app\\africa\\nation_0", "NATION_7", "Customer#000000001", "Customer#000000001()", "NATION_1", "RICA", "FRIC"]
for _name, _q in (("resolve_exact", _CASCADE[0]), ("resolve_ci", _CASCADE[1]), ("resolve_suffix", _CASCADE[2]), ("resolve_name", _CASCADE[3]), ("resolve_contains", _CASCADE[7])):
    query(_name, sql(_stage_sql(_q), "g_nodes"))(_resolve(_q))
query("resolve_cascade", sql("\nUNION ALL ".join(f"SELECT * FROM ({_stage_sql(q)})" for q in _CASCADE), "g_nodes"))(_resolve(*_CASCADE))

query("owners_chain", sql("""SELECT n.node_id, n.kind, n.fqn, n.file, n.start_line, x.distance FROM (SELECT 'o:5' AS node_id, CAST(0 AS BIGINT) AS distance UNION ALL SELECT ancestor_id, distance FROM g_anc WHERE node_id = 'o:5') x
JOIN g_nodes n ON n.node_id = x.node_id""", "g_nodes", "g_anc"))(lambda g: S.owners(g, "o:5").select("node_id", "kind", "fqn", "file", "start_line", "distance"))  # fmt: skip
query("owners_all", sql("SELECT node_id, CAST(max(distance) AS BIGINT) AS depth, arg_max(ancestor_id, distance) AS root_id FROM g_anc GROUP BY node_id", "g_anc"))(
    lambda g: g.anc.groupBy("node_id").agg(F.max("distance").alias("depth"), F.max_by("ancestor_id", "distance").alias("root_id"))
)
query("containment_closure", sql("SELECT ancestor_id, distance, count(*) AS n FROM g_anc GROUP BY ALL", "g_anc"))(lambda g: _n(g.anc, "ancestor_id", "distance"))
for _t in ("class", "method"):
    query(f"nearest_{_t}", sql(f"SELECT node_id, owner_id, distance FROM g_near_{_t}", f"g_near_{_t}"))(lambda g, t=_t: getattr(g, f"nearest_{t}").select("node_id", "owner_id", "distance"))
query("internal_refs", sql("""SELECT r.type, count(*) AS n, count(a.node_id) AS internal FROM (SELECT e.type, e.source_id, coalesce(c.owner_id, e.target_id) AS cls FROM g_edges e LEFT JOIN g_near_class c ON c.node_id = e.target_id
WHERE e.type IN ('USES', 'EXTENDS', 'IMPLEMENTS', 'USES_TRAIT')) r LEFT JOIN g_anc a ON a.node_id = r.source_id AND a.ancestor_id = r.cls GROUP BY r.type""", "g_edges", "g_anc", "g_near_class"))(S.internal_references)  # fmt: skip

query("usages_direct", sql(f"""SELECT e.source_id, e.target_id, n.fqn AS source_fqn, coalesce(e.loc_file, n.file) AS file, coalesce(e.loc_line, n.start_line) AS line
FROM (SELECT * FROM g_edges WHERE type = 'USES' AND target_id = 's:3' ORDER BY {_ORDER} LIMIT 100) e JOIN g_nodes n ON n.node_id = e.source_id""", "g_edges", "g_nodes"))(lambda g: S.usages_direct(g, "s:3"))  # fmt: skip
query("deps_direct", sql(f"""SELECT e.source_id, e.target_id, n.fqn AS target_fqn, coalesce(e.loc_file, n.file) AS file, e.loc_line AS line
FROM (SELECT * FROM g_edges WHERE type = 'USES' AND source_id = 'c:7' ORDER BY {_ORDER} LIMIT 100) e JOIN g_nodes n ON n.node_id = e.target_id""", "g_edges", "g_nodes"))(lambda g: S.deps_direct(g, "c:7"))  # fmt: skip


def _members_sql(near: str, far: str, line: str) -> str:
    return sql(f"""SELECT place, x.source_id, x.target_id, n.fqn AS {far}_fqn, coalesce(x.loc_file, n.file) AS file, {line} AS line FROM (
SELECT *, row_number() OVER (PARTITION BY {far}_id ORDER BY place) AS k FROM (SELECT *, CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS place FROM (
SELECT * FROM g_edges WHERE type = 'USES' AND {near}_id IN (SELECT 'n:0' UNION ALL SELECT node_id FROM g_anc WHERE ancestor_id = 'n:0') ORDER BY {_ORDER} LIMIT 100))) x JOIN g_nodes n ON n.node_id = x.{far}_id WHERE k = 1""", "g_edges", "g_nodes", "g_anc")  # fmt: skip


query("usages_members", _members_sql("target", "source", "coalesce(x.loc_line, n.start_line)"))(lambda g: S.usages_members(g, "n:0"))
query("deps_members", _members_sql("source", "target", "x.loc_line"))(lambda g: S.deps_members(g, "n:0"))


def _levels_sql(start: str, types: str, a: str, b: str, depth: int) -> str:
    walk = f"walk AS (SELECT '{start}' AS node_id, CAST(0 AS BIGINT) AS depth UNION SELECT e.{b}, w.depth + 1 FROM walk w JOIN g_edges e ON e.{a} = w.node_id AND e.type IN ({types}) WHERE w.depth < {depth})"
    return sql("SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id HAVING min(depth) > 0", "g_edges", ctes=walk)


query("usages_level2", _levels_sql("s:3", "'USES'", "target_id", "source_id", 2))(lambda g: S.levels(g, "s:3", S.along(g, ["USES"], False), 2))
query("deps_level2", _levels_sql("c:7", "'USES'", "source_id", "target_id", 2))(lambda g: S.levels(g, "c:7", S.along(g, ["USES"], True), 2))
query("inherit_up", _levels_sql("p:100", "'EXTENDS', 'IMPLEMENTS'", "source_id", "target_id", 5))(lambda g: S.inherit(g, "p:100", True))
query("inherit_down", _levels_sql("p:3", "'EXTENDS', 'IMPLEMENTS'", "target_id", "source_id", 5))(lambda g: S.inherit(g, "p:3", False))
query("overrides_up", _levels_sql("c:100", "'OVERRIDES'", "source_id", "target_id", 5))(lambda g: S.overrides(g, "c:100", True))
query("overrides_down", _levels_sql("c:3", "'OVERRIDES'", "target_id", "source_id", 5))(lambda g: S.overrides(g, "c:3", False))
query("override_roots", sql("""SELECT DISTINCT w.node_id, w.up AS root_id FROM walk w WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'OVERRIDES' AND e.source_id = w.up)""", "g_edges",
    ctes="walk AS (SELECT source_id AS node_id, target_id AS up, 1 AS d FROM g_edges WHERE type = 'OVERRIDES' UNION ALL SELECT w.node_id, e.target_id, w.d + 1 FROM walk w JOIN g_edges e ON e.type = 'OVERRIDES' AND e.source_id = w.up WHERE w.d < 5)"))(lambda g: g.override_roots.select("node_id", "root_id"))

# --- classification ---

query("ref_types", sql("SELECT type, source_id, target_id, ref_type FROM g_refs", "g_refs"))(lambda g: g.refs_to().select("type", "source_id", "target_id", "ref_type"))
query("ref_type_counts", sql("SELECT type, source_kind, target_kind, ref_type, count(*) AS n FROM g_refs GROUP BY ALL", "g_refs"))(lambda g: _n(g.refs_to(), "type", "source_kind", "target_kind", "ref_type"))


@query("ref_type_flags", sql("""SELECT count(*) AS n, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS hinted, CAST(sum(CASE WHEN sibling THEN 1 ELSE 0 END) AS BIGINT) AS siblings FROM (
SELECT DISTINCT e.source_id, e.target_id, EXISTS (SELECT 1 FROM g_edges h WHERE h.type = 'TYPE_HINT' AND h.source_id = e.source_id AND h.target_id = e.target_id) AS own,
EXISTS (SELECT 1 FROM g_hint_child h JOIN g_edges c ON c.type = 'CONTAINS' AND c.source_id = h.up JOIN g_nodes m ON m.node_id = c.target_id AND m.name = '__construct' WHERE c.target_id = e.source_id AND h.target_id = e.target_id AND h.down_kind = 'Property') AS sibling
FROM g_edges e JOIN g_nodes t ON t.node_id = e.target_id AND t.kind IN ('Class', 'Interface', 'Trait', 'Enum') WHERE e.type = 'USES')""", "g_edges", "g_nodes", "g_hint_child"))  # fmt: skip
def _flags(g):
    from .plans.facts import type_flags

    hinting = "Argument", "Property", "Method", "Function"
    f = type_flags(g.of_kind(*hinting, "Class", "Interface", "Trait", "Enum"), g.of_type, g.containing(*hinting))
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("long")
    return f.agg(F.count(F.lit(1)).alias("n"), one("has_return").alias("hinted"), one("has_class_property").alias("siblings"))


query("call_kind_map", sql("""SELECT call_kind, callee_kind, CASE call_kind WHEN 'method' THEN 'method_call' WHEN 'method_static' THEN 'static_call' WHEN 'constructor' THEN 'instantiation' WHEN 'access' THEN 'property_access' WHEN 'access_static' THEN 'static_property' WHEN 'function' THEN 'function_call' END AS ref_type, count(*) AS n FROM g_callfact GROUP BY ALL""", "g_callfact"))(
    lambda g: _n(g.sites.withColumn("ref_type", call_reference(F.col("call_kind"), F.col("callee_kind"))), "call_kind", "callee_kind", "ref_type")
)
_ON, _ON_KIND = "on_expr", "on_kind"
query("receiver_on", sql("SELECT call_id, on_expr, on_kind, on_symbol FROM g_callfact", "g_callfact"))(lambda g: g.calls.select("call_id", "on_expr", "on_kind", "on_symbol"))


query("method_fqn", sql("SELECT node_id, CASE WHEN kind = 'Method' AND NOT ends_with(fqn, '()') THEN concat(fqn, '()') ELSE fqn END AS shown, CASE WHEN kind IN ('Method', 'Function') THEN concat(name, '()') WHEN kind = 'Property' AND NOT starts_with(name, '$') THEN concat('$', name) ELSE name END AS short FROM g_nodes", "g_nodes"))(
    lambda g: g.nodes.select("node_id", method_fqn(F.col("fqn"), F.col("kind")).alias("shown"), display_name(F.col("kind"), F.col("name")).alias("short"))
)
query("param_name", sql("SELECT split_part(parameter, '.', -1) AS name, count(*) AS n FROM g_edges WHERE type = 'ARGUMENT' GROUP BY 1", "g_edges"))(lambda g: _n(g.args.withColumn("name", parameter_name(F.col("parameter"))), "name"))

# --- facts ---

_CALL = ["call_id", "call_kind", "callee_id", "callee_kind", "scope_id", "receiver_id", "receiver_value_kind", "result_id", "local_id", "local_type_id"]
query("call_facts", sql(f"SELECT {', '.join(_CALL)} FROM g_callfact", "g_callfact"))(lambda g: g.calls.select(*_CALL))
query("call_arguments", sql("SELECT source_id AS call_id, count(*) AS n, string_agg(concat(position, ':', expression, ':', target_id), ',' ORDER BY position) AS arguments FROM g_edges WHERE type = 'ARGUMENT' GROUP BY 1", "g_edges"))(
    lambda g: g.args.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "expression", "value_id"))), lambda x: F.concat(x.position, F.lit(":"), x.expression, F.lit(":"), x.value_id)), ",").alias("arguments"))
)
query("argument_sources", sql("""SELECT a.source_id AS call_id, a.position, a.target_id AS value_id, p.source_id AS source_call_id, t.target_id AS value_type_id FROM g_edges a
LEFT JOIN g_edges p ON p.type = 'PRODUCES' AND p.target_id = a.target_id LEFT JOIN g_edges t ON t.type = 'TYPE_OF' AND t.source_id = a.target_id WHERE a.type = 'ARGUMENT'""", "g_edges"))(
    lambda g: g.args.select("call_id", "position", "value_id", "source_call_id", "value_type_id")
)
query("promoted_params", sql("SELECT e.source_id AS property_id, e.target_id AS parameter_id FROM g_edges e JOIN g_nodes p ON p.node_id = e.source_id AND p.kind = 'Property' JOIN g_nodes v ON v.node_id = e.target_id AND contains(v.fqn, '__construct()') WHERE e.type = 'ASSIGNED_FROM'", "g_edges", "g_nodes"))(
    lambda g: D.promoted(g.nodes, g.of_type("ASSIGNED_FROM"))
)
query("consumed_calls", sql("SELECT DISTINCT p.source_id AS call_id FROM g_edges p JOIN g_edges u ON u.type IN ('RECEIVER', 'ARGUMENT') AND u.target_id = p.target_id AND u.source_id <> p.source_id WHERE p.type = 'PRODUCES'", "g_edges"))(C.consumed_calls)

# --- handlers and classes ---

_INSIDE = "SELECT 1 FROM g_anc a WHERE a.node_id = {0} AND a.ancestor_id = {1}"
_CTOR = """SELECT k.source_id AS class_id, c.scope_id, min(c.call_id) AS call_id FROM g_callfact c JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = c.callee_id WHERE c.call_kind = 'constructor' GROUP BY 1, 2"""
query("ctor_calls", sql(_CTOR, "g_callfact", "g_edges"))(lambda g: C.constructor_calls(g).select("class_id", "scope_id", "call_id"))
query("handler_instantiation", sql(f"SELECT x.class_id, x.scope_id, x.call_id, n.fqn FROM ({_CTOR}) x JOIN g_nodes n ON n.node_id = x.scope_id", "g_callfact", "g_edges", "g_nodes"))(C.handler_instantiation)
_INJ = "SELECT DISTINCT h.target_id, c.source_id AS class_id FROM g_edges h JOIN g_nodes p ON p.node_id = h.source_id AND p.kind = 'Property' JOIN g_edges c ON c.type = 'CONTAINS' AND c.target_id = h.source_id WHERE h.type = 'TYPE_HINT'"
query("class_injection", sql(_INJ, "g_edges", "g_nodes"))(C.injections)
query("typed_properties", sql("SELECT h.target_id, h.source_id AS property_id FROM g_edges h JOIN g_nodes p ON p.node_id = h.source_id AND p.kind = 'Property' WHERE h.type = 'TYPE_HINT'", "g_edges", "g_nodes"))(C.typed_properties)
query("class_children", sql("SELECT target_id, source_id, ref_type, source_file AS file, source_line AS line FROM g_refs WHERE ref_type IN ('extends', 'implements')", "g_refs"))(C.class_children)
_INCOMING = f"""incoming AS (SELECT r.*, nc.owner_id AS class_id, nm.owner_id AS method_id FROM g_refs r LEFT JOIN g_near_class nc ON nc.node_id = r.source_id LEFT JOIN g_near_method nm ON nm.node_id = r.source_id
WHERE r.source_kind <> 'File' AND NOT EXISTS ({_INSIDE.format('r.source_id', 'r.target_id')}))"""
_IN = ("g_refs", "g_near_class", "g_near_method", "g_anc", "g_edges", "g_nodes")
query("handler_method_call", sql(f"""SELECT c.source_id AS target_class, r.target_id, r.source_id, concat(r.target_name, '()') AS callee FROM incoming r JOIN g_edges c ON c.type = 'CONTAINS' AND c.target_id = r.target_id
WHERE r.ref_type = 'method_call' AND NOT EXISTS (SELECT 1 FROM ({_INJ}) i WHERE i.target_id = c.source_id AND i.class_id = r.class_id)""", *_IN, ctes=_INCOMING))(C.handler_method_call)  # fmt: skip
_AT = """sites AS (SELECT r.source_id, r.target_id, r.loc_file, r.loc_line, min(c.call_id) AS call_id FROM (SELECT DISTINCT source_id, target_id, loc_file, loc_line FROM g_edges WHERE type = 'USES') r JOIN g_callfact c ON c.scope_id = r.source_id AND c.call_file = r.loc_file
AND (c.call_line = r.loc_line OR (c.call_kind = 'constructor' AND abs(c.call_line - r.loc_line) <= 1)) GROUP BY ALL)"""
query("handler_property_groups", sql("""SELECT target_id, "by", on_expr, on_kind, count(*) AS n, string_agg(CAST(coalesce(loc_line, -1) AS VARCHAR), ',' ORDER BY coalesce(loc_line, -1)) AS lines FROM (
SELECT r.target_id, coalesce(r.method_id, r.source_id) AS "by", c.on_expr, c.on_kind, r.loc_line FROM incoming r LEFT JOIN sites t ON t.source_id = r.source_id AND t.target_id = r.target_id AND t.loc_file = r.loc_file AND t.loc_line = r.loc_line
LEFT JOIN g_callfact c ON c.call_id = t.call_id WHERE r.ref_type = 'property_access') GROUP BY 1, 2, 3, 4""", *_IN, "g_callfact", ctes=f"{_INCOMING}, {_AT}"))(C.handler_property_groups)  # fmt: skip
query("handler_param_return", sql(f"""SELECT target_id, entry_id, arg_min(ref_type, (file, line, source_id, ref_type)) AS ref_type, count(*) AS n FROM (SELECT *, coalesce(loc_file, source_file, '') AS file, coalesce(loc_line, source_line, 0) AS line,
CASE WHEN ref_type = 'return_type' AND source_kind IN ('Method', 'Function') THEN source_id WHEN source_kind IN {_TYPES} THEN source_id ELSE class_id END AS entry_id
FROM incoming WHERE ref_type IN ('parameter_type', 'return_type', 'type_hint')) WHERE entry_id IS NOT NULL GROUP BY 1, 2""", *_IN, ctes=_INCOMING))(C.handler_param_return)  # fmt: skip
_REGISTERED = "('instantiation', 'extends', 'implements', 'property_type', 'method_call', 'property_access', 'parameter_type', 'return_type', 'type_hint')"
query("registered_refs", sql(f"SELECT ref_type, ref_type IN {_REGISTERED} AS shown, count(*) AS n FROM g_refs GROUP BY 1, 2", "g_refs"))(lambda g: _n(g.refs_to().withColumn("shown", F.col("ref_type").isin(*REGISTERED)), "ref_type", "shown"))
_PRIORITY = "CASE ref_type WHEN 'instantiation' THEN 0 WHEN 'extends' THEN 1 WHEN 'implements' THEN 1 WHEN 'property_type' THEN 2 WHEN 'method_call' THEN 3 WHEN 'static_call' THEN 3 WHEN 'property_access' THEN 4 WHEN 'parameter_type' THEN 5 WHEN 'return_type' THEN 5 WHEN 'type_hint' THEN 6 ELSE 10 END"
query("class_used_by", sql(f"""SELECT target_id, place, source_id, ref_type, CAST(priority AS BIGINT) AS priority, class_id, method_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY priority, coalesce(loc_file, source_file, ''), coalesce(loc_line, source_line, 0), source_id, ref_type, type) AS BIGINT) AS place
FROM (SELECT *, {_PRIORITY} AS priority FROM incoming r WHERE target_kind IN {_TYPES} AND ref_type IN {_REGISTERED} AND NOT (ref_type = 'method_call' AND EXISTS (SELECT 1 FROM ({_INJ}) i WHERE i.target_id = r.target_id AND i.class_id = r.class_id)))) WHERE place <= 100""", *_IN, ctes=_INCOMING))(C.used_by)  # fmt: skip
query("used_by_counts", sql("SELECT target_id, ref_type, count(*) AS n, count(DISTINCT method_id) AS methods FROM incoming GROUP BY 1, 2", *_IN, ctes=_INCOMING))(C.used_by_counts)
query("external_calls", sql(f"""SELECT k.source_id AS class_id, c.call_id, c.scope_id, c.callee_id, {_ON} AS on_expr, {_ON_KIND} AS on_kind FROM g_callfact c JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = c.callee_id
WHERE c.callee_kind = 'Method' AND c.receiver_id IS NOT NULL AND NOT EXISTS ({_INSIDE.format('c.call_id', 'k.source_id')})""", "g_callfact", "g_edges", "g_anc"))(C.external_calls)  # fmt: skip
query("external_props", sql(f"""SELECT k.source_id AS class_id, c.callee_id, c.scope_id, {_ON} AS on_expr, {_ON_KIND} AS on_kind, count(*) AS accesses, min(call_line) AS first_line FROM g_callfact c JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = c.callee_id
WHERE c.callee_kind = 'Property' AND NOT EXISTS ({_INSIDE.format('c.call_id', 'k.source_id')}) GROUP BY ALL""", "g_callfact", "g_edges", "g_anc"))(C.external_accesses)  # fmt: skip
query("method_callers", sql("SELECT callee_id, scope_id, min(call_line) AS line, count(*) AS sites FROM g_callfact WHERE scope_kind IN ('Method', 'Function') GROUP BY 1, 2", "g_callfact"))(C.callers)
query("callers_with_roots", sql("""SELECT DISTINCT m.node_id, c.scope_id FROM (SELECT node_id, node_id AS callee_id FROM g_nodes WHERE kind = 'Method' UNION ALL
SELECT w.node_id, w.up FROM walk w WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'OVERRIDES' AND e.source_id = w.up)) m JOIN g_callfact c ON c.callee_id = m.callee_id AND c.scope_kind = 'Method'""", "g_edges", "g_nodes", "g_callfact",
    ctes="walk AS (SELECT source_id AS node_id, target_id AS up FROM g_edges WHERE type = 'OVERRIDES' UNION SELECT w.node_id, e.target_id FROM walk w JOIN g_edges e ON e.type = 'OVERRIDES' AND e.source_id = w.up)"))(C.callers_with_roots)
_HINTS = """hinted AS (SELECT class_id, used_id, min(rank) AS rank FROM (
SELECT c.source_id AS class_id, h.target_id AS used_id, CASE m.kind WHEN 'Property' THEN 1 ELSE 3 END AS rank FROM g_edges c JOIN g_nodes m ON m.node_id = c.target_id AND m.kind IN ('Property', 'Method') JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = m.node_id WHERE c.type = 'CONTAINS'
UNION ALL SELECT c.source_id, h.target_id, 2 FROM g_edges c JOIN g_nodes m ON m.node_id = c.target_id AND m.kind = 'Method' JOIN g_edges d ON d.type = 'CONTAINS' AND d.source_id = m.node_id JOIN g_nodes a ON a.node_id = d.target_id AND a.kind = 'Argument'
JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = a.node_id WHERE c.type = 'CONTAINS') GROUP BY 1, 2),
made AS (SELECT DISTINCT c.source_id AS class_id, k.source_id AS used_id FROM g_callfact x JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = x.callee_id JOIN g_edges c ON c.type = 'CONTAINS' AND c.target_id = x.scope_id WHERE x.call_kind = 'constructor'),
level AS (SELECT source_id AS class_id, target_id AS used_id, ref_type FROM g_refs WHERE type IN ('EXTENDS', 'IMPLEMENTS', 'USES_TRAIT'))"""
query("class_uses", sql(f"""SELECT class_id, used_id, ref_type, CAST(CASE WHEN ref_type IN ('extends', 'implements', 'uses_trait') THEN 0 WHEN ref_type = 'property_type' THEN 1 WHEN ref_type IN ('parameter_type', 'return_type') THEN 2 WHEN ref_type = 'instantiation' THEN 3 WHEN ref_type = 'type_hint' THEN 4
WHEN ref_type IN ('method_call', 'property_access') THEN 5 ELSE 99 END AS BIGINT) AS priority, n FROM (SELECT class_id, used_id, arg_min(ref_type, (CASE WHEN ref_type IN ('extends', 'implements', 'uses_trait') THEN -1 WHEN ref_type = 'instantiation' THEN 0 WHEN ref_type = 'property_type' THEN 1
WHEN ref_type IN ('method_call', 'property_access') THEN 2 WHEN ref_type = 'parameter_type' THEN 3 WHEN ref_type = 'return_type' THEN 4 WHEN ref_type = 'type_hint' THEN 5 ELSE 10 END, ref_type)) AS ref_type, count(*) AS n FROM (
SELECT u.class_id, u.used_id, CASE WHEN h.rank IN (1, 3) THEN CASE h.rank WHEN 1 THEN 'property_type' ELSE 'return_type' END WHEN m.class_id IS NOT NULL THEN 'instantiation' WHEN h.rank = 2 THEN 'parameter_type' ELSE u.ref_type END AS ref_type FROM (
SELECT c.source_id AS class_id, CASE WHEN r.target_kind IN {_TYPES} THEN r.target_id ELSE o.source_id END AS used_id, r.ref_type FROM g_refs r JOIN g_edges c ON c.type = 'CONTAINS' AND c.target_id = r.source_id
LEFT JOIN g_edges o ON o.type = 'CONTAINS' AND o.target_id = r.target_id WHERE r.type = 'USES') u LEFT JOIN hinted h USING (class_id, used_id) LEFT JOIN made m USING (class_id, used_id)
WHERE u.used_id IS NOT NULL AND u.used_id <> u.class_id AND NOT EXISTS (SELECT 1 FROM level l WHERE l.class_id = u.class_id AND l.used_id = u.used_id)
UNION ALL SELECT class_id, used_id, ref_type FROM level) GROUP BY 1, 2)""", "g_refs", "g_edges", "g_callfact", "g_nodes", ctes=_HINTS))(C.class_uses)  # fmt: skip

# --- interfaces ---

_SUB = "sub AS (SELECT source_id AS node_id, target_id AS up, CAST(1 AS BIGINT) AS d FROM g_edges WHERE type = 'EXTENDS' UNION ALL SELECT s.node_id, e.target_id, s.d + 1 FROM sub s JOIN g_edges e ON e.type = 'EXTENDS' AND e.source_id = s.up)"
query("concrete_implementors", sql("""SELECT interface_id, class_id, min(distance) AS distance FROM (SELECT target_id AS interface_id, source_id AS class_id, CAST(0 AS BIGINT) AS distance FROM g_edges WHERE type = 'IMPLEMENTS'
UNION ALL SELECT e.target_id, s.node_id, s.d FROM g_edges e JOIN sub s ON s.up = e.source_id WHERE e.type = 'IMPLEMENTS') GROUP BY 1, 2""", "g_edges", ctes=_SUB))(C.implementors)  # fmt: skip
query("interface_injection", sql("""SELECT DISTINCT x.interface_id, h.source_id AS property_id, x.via FROM (SELECT interface_id, target_id, via FROM own UNION ALL SELECT o.interface_id, e.source_id, 'implementor' FROM own o JOIN g_edges e ON e.type = 'IMPLEMENTS' AND e.target_id = o.target_id) x
JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.target_id = x.target_id JOIN g_nodes p ON p.node_id = h.source_id AND p.kind = 'Property'""", "g_edges", "g_nodes",
    ctes=_SUB + ", own AS (SELECT node_id AS interface_id, node_id AS target_id, 'self' AS via FROM g_nodes WHERE kind = 'Interface' UNION ALL SELECT n.node_id, s.node_id, 'child' FROM g_nodes n JOIN sub s ON s.up = n.node_id WHERE n.kind = 'Interface')"))(C.interface_injections)
query("contract_relevance", sql("""SELECT c.source_id AS class_id, count(*) AS methods, count(x.callee_id) AS called, count(x.callee_id) > 0 AS relevant FROM g_edges c JOIN g_nodes m ON m.node_id = c.target_id AND m.kind = 'Method'
LEFT JOIN (SELECT DISTINCT target_id AS callee_id FROM g_edges WHERE type = 'CALLS') x ON x.callee_id = c.target_id WHERE c.type = 'CONTAINS' GROUP BY 1""", "g_edges", "g_nodes"))(C.contract_relevance)  # fmt: skip

# --- methods, properties, values ---

query("exec_flow_level1", sql("""SELECT scope_id, call_id, callee_id, CASE call_kind WHEN 'method' THEN 'method_call' WHEN 'method_static' THEN 'static_call' WHEN 'constructor' THEN 'instantiation' WHEN 'access' THEN 'property_access' WHEN 'access_static' THEN 'static_property' WHEN 'function' THEN 'function_call' END AS ref_type, local_id, local_type_id FROM (
SELECT *, row_number() OVER (PARTITION BY scope_id, callee_id ORDER BY call_id) AS k FROM g_callfact WHERE scope_kind = 'Method' AND callee_id <> scope_id) WHERE k = 1""", "g_callfact"))(C.execution_flow)  # fmt: skip
query("orphan_filter", sql("""SELECT a.call_id, a.scope_id, a.callee_id FROM g_callfact a WHERE a.callee_kind = 'Property' AND NOT EXISTS (SELECT 1 FROM g_edges x JOIN g_callfact o ON o.call_id = x.source_id
WHERE x.type = 'ARGUMENT' AND o.scope_id = a.scope_id AND o.call_id <> a.call_id AND contains(x.expression, ltrim(a.callee_name, '$')))""", "g_callfact", "g_edges"))(C.orphan_accesses)  # fmt: skip
query("type_references", sql("""SELECT r.source_id AS scope_id, r.target_id, r.ref_type FROM g_refs r WHERE r.source_kind = 'Method' AND r.ref_type IN ('property_type', 'type_hint') AND NOT EXISTS (
SELECT 1 FROM g_callfact c JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = c.callee_id WHERE c.call_kind = 'constructor' AND c.scope_id = r.source_id AND k.source_id = r.target_id)""", "g_refs", "g_callfact", "g_edges"))(C.type_references)  # fmt: skip
query("property_used_by", sql(f"SELECT callee_id AS property_id, scope_id, count(*) AS sites, count(DISTINCT {_ON}) AS receivers, min(call_line) AS line FROM g_callfact WHERE callee_kind = 'Property' GROUP BY 1, 2", "g_callfact"))(C.property_used_by)
query("property_callers", sql("SELECT parameter, count(DISTINCT source_id) AS calls, count(DISTINCT target_id) AS values, min(target_id) AS first_value FROM g_edges WHERE type = 'ARGUMENT' GROUP BY 1", "g_edges"))(C.parameter_callers)
query("value_consumers", sql("SELECT target_id AS value_id, source_id AS call_id, lower(type) AS how FROM g_edges WHERE type IN ('RECEIVER', 'ARGUMENT')", "g_edges"))(C.value_consumers)
query("value_sources", sql("SELECT a.source_id AS value_id, a.target_id AS from_id, p.source_id AS call_id, c.target_id AS callee_id FROM g_edges a JOIN g_edges p ON p.type = 'PRODUCES' AND p.target_id = a.target_id JOIN g_edges c ON c.type = 'CALLS' AND c.source_id = p.source_id WHERE a.type = 'ASSIGNED_FROM'", "g_edges"))(C.value_sources)
query("param_uses", sql("SELECT target_id AS value_id, count(*) AS uses, count(DISTINCT parameter) AS parameters FROM g_edges WHERE type = 'ARGUMENT' GROUP BY 1", "g_edges"))(lambda g: g.args.groupBy("value_id").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("parameter").alias("parameters")))
query("dataflow_closure", sql("SELECT root_id, count(*) AS reached, max(depth) AS depth FROM (SELECT root_id, node_id, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0) GROUP BY 1", "g_dataflow", "g_nodes",
    ctes="walk AS (SELECT node_id AS root_id, node_id, CAST(0 AS BIGINT) AS depth FROM g_nodes WHERE value_kind = 'result' UNION SELECT w.root_id, d.target_id, w.depth + 1 FROM walk w JOIN g_dataflow d ON d.source_id = w.node_id WHERE w.depth < 3)"))(C.flow_reach)
query("nearest_call_line", sql("""SELECT source_id, target_id, call_id, off FROM (SELECT r.source_id, r.target_id, c.call_id, CAST(abs(c.call_line - coalesce(r.loc_line, 0)) AS BIGINT) AS off, row_number() OVER (PARTITION BY r.source_id, r.target_id ORDER BY abs(c.call_line - coalesce(r.loc_line, 0)), c.call_id) AS k
FROM g_refs r JOIN g_callfact c ON c.scope_id = r.source_id AND c.callee_id = r.target_id WHERE r.ref_type IN ('method_call', 'property_access')) WHERE k = 1""", "g_refs", "g_callfact"))(C.nearest_calls)  # fmt: skip

# --- definitions ---

query("definition_parents", sql("SELECT n.node_id, n.kind, n.fqn, e.source_id AS parent_id FROM g_nodes n LEFT JOIN g_edges e ON e.type = 'CONTAINS' AND e.target_id = n.node_id", "g_nodes", "g_edges"))(lambda g: D.parents(g).select("node_id", "kind", "fqn", "parent_id"))
query("definition_children", sql("SELECT e.source_id, n.kind AS child_kind, count(*) AS n, arg_min(e.target_id, n.node_ord) AS first_child FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type = 'CONTAINS' GROUP BY 1, 2", "g_edges", "g_nodes"))(D.children)
query("definition_types", sql("SELECT e.source_id, e.type, string_agg(DISTINCT n.fqn, '|' ORDER BY n.fqn) AS fqn, count(*) AS n FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type IN ('TYPE_HINT', 'TYPE_OF') GROUP BY 1, 2", "g_edges", "g_nodes"))(D.types)
query("definition_supertypes", sql("""SELECT e.source_id, coalesce(string_agg(DISTINCT CASE WHEN type = 'EXTENDS' THEN n.fqn END, '|' ORDER BY CASE WHEN type = 'EXTENDS' THEN n.fqn END), '') AS extends,
coalesce(string_agg(DISTINCT CASE WHEN type = 'IMPLEMENTS' THEN n.fqn END, '|' ORDER BY CASE WHEN type = 'IMPLEMENTS' THEN n.fqn END), '') AS implements, coalesce(string_agg(DISTINCT CASE WHEN type = 'USES_TRAIT' THEN n.fqn END, '|' ORDER BY CASE WHEN type = 'USES_TRAIT' THEN n.fqn END), '') AS traits FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type IN ('EXTENDS', 'IMPLEMENTS', 'USES_TRAIT') GROUP BY 1""", "g_edges", "g_nodes"))(D.supertypes)  # fmt: skip
query("definition_flags", sql("SELECT n.node_id, e.source_id IS NOT NULL AS is_override, n.name = '__construct' AS is_constructor, CAST(CASE WHEN e.source_id IS NOT NULL THEN 0 ELSE 2 END AS BIGINT) AS place FROM g_nodes n LEFT JOIN (SELECT DISTINCT source_id FROM g_edges WHERE type = 'OVERRIDES') e ON e.source_id = n.node_id WHERE n.kind = 'Method'", "g_nodes", "g_edges"))(D.method_flags)
query("value_types", sql("SELECT n.node_id, n.value_kind, t.fqn AS type_fqn, m.owner_id AS scope_id FROM g_nodes n LEFT JOIN g_edges e ON e.type = 'TYPE_OF' AND e.source_id = n.node_id LEFT JOIN g_nodes t ON t.node_id = e.target_id LEFT JOIN g_near_method m ON m.node_id = n.node_id WHERE n.kind = 'Value'", "g_nodes", "g_edges", "g_near_method"))(lambda g: D.value_types(g).select("node_id", "value_kind", "type_fqn", "scope_id"))


@query("property_doc", """SELECT name, CASE WHEN m = 0 THEN 'private' WHEN m = 1 THEN 'protected' ELSE 'public' END AS visibility, m = 1 AS readonly, m = 2 AS static, p_brand AS type, false AS abstract
FROM (SELECT concat('$p', p_partkey) AS name, p_partkey % 3 AS m, p_brand FROM part)""")
def _docs(g):
    p = g.source.table("part")
    m = F.col("p_partkey") % 3
    name = F.concat(F.lit("$p"), "p_partkey")
    seen = F.when(m == 0, "private ").when(m == 1, "protected readonly ").otherwise("public static ")
    doc = F.concat(F.lit("```php\n"), seen, F.lit("\\App\\"), "p_brand", F.lit(" "), name, F.lit("\n```"))
    return D.property_docs(p.select(name.alias("name"), F.array(doc).alias("documentation")))


# --- flows ---

_F = ("g_flows", "g_emits", "g_handled_by")
query("list_flows", sql("SELECT f.flow_id, f.type, f.class_node_id, f.method_node_id, n.fqn AS entry_fqn FROM g_flows f LEFT JOIN g_nodes n ON n.node_id = f.method_node_id", "g_flows", "g_nodes"))(W.list_flows)
query("find_flow", sql("SELECT f.flow_id, f.type, f.class_node_id, f.method_node_id, n.fqn AS entry_fqn FROM g_flows f LEFT JOIN g_nodes n ON n.node_id = f.method_node_id WHERE contains(lower(f.flow_id), 'http:1') OR contains(lower(n.fqn), 'http:1') ORDER BY f.flow_id LIMIT 50", "g_flows", "g_nodes"))(lambda g: W.find_flow(g, "HTTP:1"))
query("flow_dispatch_out", sql("""SELECT m.flow_id, m.to_label, m.to_id, count(DISTINCT m.call_node_id) AS calls, count(*) AS n, coalesce(max(h.handlers), 0) AS handlers FROM g_emits m LEFT JOIN (SELECT from_id, count(DISTINCT flow_id) AS handlers FROM g_handled_by GROUP BY 1) h ON h.from_id = m.to_id GROUP BY 1, 2, 3""", *_F))(W.dispatches_out)
query("flow_dispatch_in", sql("SELECT h.flow_id, h.from_label, h.from_id, h.priority, coalesce(e.emitters, 0) AS emitters FROM g_handled_by h LEFT JOIN (SELECT to_id, count(DISTINCT flow_id) AS emitters FROM g_emits GROUP BY 1) e ON e.to_id = h.from_id", *_F))(W.dispatches_in)
for _label, _name in (("Message", "list_messages"), ("Event", "list_events")):
    query(_name, sql(f"SELECT coalesce(s.id, t.from_id) AS id, coalesce(s.sources, 0) AS sources, coalesce(t.targets, 0) AS targets FROM (SELECT to_id AS id, count(DISTINCT flow_id) AS sources FROM g_emits WHERE to_label = '{_label}' GROUP BY 1) s FULL JOIN (SELECT from_id, count(DISTINCT flow_id) AS targets FROM g_handled_by WHERE from_label = '{_label}' GROUP BY 1) t ON t.from_id = s.id", *_F))(lambda g, l=_label: W.list_entities(g, l))
query("list_http_clients", """WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT concat('http:', k) AS id, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS flows FROM e WHERE k IS NOT NULL GROUP BY k""")(W.list_http_clients)
for _entity, _name in (("message:click", "message_detail"), ("event:error", "event_detail")):
    query(_name, sql(f"SELECT 'source' AS side, flow_id, count(DISTINCT call_node_id) AS calls, CAST(NULL AS BIGINT) AS priority FROM g_emits WHERE to_id = '{_entity}' GROUP BY flow_id UNION ALL SELECT 'target', flow_id, NULL, priority FROM g_handled_by WHERE from_id = '{_entity}'", *_F))(lambda g, e=_entity: W.entity_detail(g, e))
query("flow_names", sql("SELECT f.flow_id, CASE f.type WHEN 'http' THEN concat('GET /', f.user_id) WHEN 'cli' THEN concat('app:', f.user_id) ELSE split_part(n.fqn, chr(92), -1) END AS name FROM g_flows f JOIN g_nodes n ON n.node_id = f.class_node_id", "g_flows", "g_nodes"))(W.flow_names)
query("namespace_filter", sql("SELECT node_id, fqn FROM g_nodes WHERE starts_with(fqn, concat('App', chr(92), 'ASIA')) OR starts_with(fqn, concat('App', chr(92), 'Brand#1'))", "g_nodes"))(lambda g: W.in_namespaces(g.nodes, "fqn", ["App\\ASIA", "App\\Brand#1"]).select("node_id", "fqn"))
query("dispatch_context", sql("""SELECT f.flow_id, coalesce(e.messages, '') AS messages, coalesce(e.events, '') AS events, coalesce(h.handles, '') AS handles FROM g_flows f LEFT JOIN (SELECT flow_id, coalesce(string_agg(DISTINCT to_id, ',' ORDER BY to_id) FILTER (WHERE to_label = 'Message'), '') AS messages,
coalesce(string_agg(DISTINCT to_id, ',' ORDER BY to_id) FILTER (WHERE to_label = 'Event'), '') AS events FROM g_emits GROUP BY 1) e ON e.flow_id = f.flow_id LEFT JOIN (SELECT flow_id, string_agg(DISTINCT from_id, ',' ORDER BY from_id) AS handles FROM g_handled_by GROUP BY 1) h ON h.flow_id = f.flow_id""", *_F))(W.dispatch_context)  # fmt: skip

# --- reconcile: suppliers as stored, against suppliers as a new import would have them ---


def _plan(g):
    s = g.source.table("supplier")
    current = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.concat(F.lit("note "), "s_suppkey").alias("note"))
    desired = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("nation"))
    return R.reconcile(current, desired, "id", ["note"])


_PLAN = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'deleted' WHEN s_suppkey % 7 = 0 THEN 'created' WHEN s_suppkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS action, s_name AS name,
CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS nation, CASE WHEN s_suppkey % 7 <> 0 THEN concat('note ', s_suppkey) END AS note FROM supplier WHERE s_suppkey % 7 <> 0 OR s_suppkey % 5 <> 0"""
query("reconcile_upsert", f"SELECT id, action, name, CAST(nation AS BIGINT) AS nation, note FROM ({_PLAN})")(lambda g: _plan(g).withColumn("nation", F.col("nation").cast("long")))
query("reconcile_orphans", f"SELECT id FROM ({_PLAN}) WHERE action = 'deleted'")(lambda g: R.orphans(_plan(g), "id"))


@query("edge_replace_gap", "SELECT count(*) AS wanted, count(*) FILTER (WHERE o_custkey % 10 <> 0) AS made, count(*) FILTER (WHERE o_custkey % 10 = 0) AS gap FROM orders")
def _gap(g):
    wanted = g.source.table("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"))
    customers = g.source.table("customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"))
    return R.edge_gap(wanted, customers, wanted.select(F.col("target_id").alias("id")))


@query("edge_replace", sql("SELECT type, count(*) AS n FROM (SELECT type FROM g_edges WHERE type <> 'OVERRIDES' UNION ALL SELECT 'OVERRIDES' FROM customer WHERE c_custkey > 10) GROUP BY type", "g_edges"))
def _replace(g):
    new = g.source.table("customer").where("c_custkey > 10").select(F.concat(F.lit("c:"), "c_custkey").alias("source_id"), F.lit("c:0").alias("target_id"))
    for c in g.edges.columns:
        if c not in ("type", "source_id", "target_id"):
            new = new.withColumn(c, F.lit(None).cast(g.edges.schema[c].dataType))
    return _n(R.replace_edges(g.edges, new, "OVERRIDES"), "type")


# --- texts ---

query("source_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[3:6], chr(10)) AS source FROM documents WHERE len(string_split(text, chr(10))) > 2")(
    lambda g: g.source.table("documents").select("doc_id", line_range(F.col("text"), F.lit(2), F.lit(5)).alias("source")).where("source is not null")
)
_CUT = "CASE WHEN length(text) > 400 THEN concat(substr(text, 1, 400), chr(10), '// ... truncated ...') ELSE text END"
query("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")(lambda g: X.estimates(g.source.table("documents"), 100).select("doc_id", "tokens"))
query("chunk_truncate", f"SELECT doc_id, CAST(length({_CUT}) AS BIGINT) AS kept_chars, md5({_CUT}) AS kept_md5 FROM documents")(lambda g: X.estimates(g.source.table("documents"), 100).select("doc_id", "kept_chars", "kept_md5"))
query("chunk_pack", """WITH RECURSIVE l AS (SELECT doc_id, i, CAST(length(x) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
w AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS chunk, n AS held, n FROM l WHERE i = 1
UNION ALL SELECT w.doc_id, l.i, CASE WHEN w.held > 0 AND w.held + l.n > 1200 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held > 0 AND w.held + l.n > 1200 THEN l.n ELSE w.held + l.n END, l.n FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, chunk, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM w GROUP BY 1, 2""")(lambda g: X.line_packs(g.source.table("documents"), 1200))  # fmt: skip


def _explained(g):
    return g.source.table("labels").where("quality is not null").select(F.concat(F.lit("c:"), "doc_id").alias("node_id"))


_EX = "SELECT concat('c:', doc_id) AS node_id FROM labels WHERE quality IS NOT NULL"
query("enrichable", sql(f"SELECT node_id, kind, fqn FROM g_nodes WHERE kind IN ('Class', 'Method') AND file IS NOT NULL AND NOT starts_with(fqn, concat('App', chr(92), 'ASIA')) AND node_id NOT IN ({_EX})", "g_nodes"))(lambda g: X.enrichable(g, _explained(g), ["App\\ASIA"], ["Class", "Method"]))
query("enrich_status", sql(f"SELECT n.kind, count(*) AS total, count(e.node_id) AS explained FROM g_nodes n LEFT JOIN ({_EX}) e ON e.node_id = n.node_id WHERE n.kind IN ('Class', 'Method') GROUP BY 1", "g_nodes"))(lambda g: X.status(g, _explained(g), ["Class", "Method"]))
query("type_context", sql("SELECT e.source_id AS node_id, string_agg(DISTINCT n.fqn, ',' ORDER BY n.fqn) AS types FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type = 'TYPE_HINT' GROUP BY 1", "g_edges", "g_nodes"))(X.type_context)
query("usage_context", sql("SELECT target_id AS node_id, CAST(k AS BIGINT) AS k, source_id FROM (SELECT e.target_id, e.source_id, row_number() OVER (PARTITION BY e.target_id ORDER BY e.source_id) AS k FROM (SELECT DISTINCT target_id, source_id FROM g_edges WHERE type = 'USES') e JOIN g_nodes n ON n.node_id = e.target_id AND n.kind IN ('Class', 'Interface')) WHERE k <= 5", "g_edges", "g_nodes"))(X.usage_context)

# --- vectors ---


def _vector(g):
    return g.vectors.where("vec_id = 0").first().embedding


_SCORED = "SELECT vec_id, collection, node_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM g_vectors WHERE vec_id = 0)), 4) AS score FROM g_vectors"
query("search_topk", sql(f"SELECT vec_id, node_id, score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10", "g_vectors"))(lambda g: V.search(g.vectors, _vector(g)))
query("search_merged", sql(f"""SELECT vec_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, vec_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, vec_id) AS k FROM ({_SCORED})) WHERE k <= 10)
WHERE r = 1 ORDER BY score DESC, node_id LIMIT 10""", "g_vectors"))(lambda g: V.search_all(g.vectors, _vector(g)))  # fmt: skip


@query("flagship", sql("""SELECT u.place, u.source_id, u.target_id, u.file, u.line, r.ref_type, c.owner_id AS class_id FROM ({members}) u JOIN g_refs r ON r.type = 'USES' AND r.source_id = u.source_id AND r.target_id = u.target_id
LEFT JOIN g_near_class c ON c.node_id = u.source_id""".replace("{members}", f"""SELECT place, x.source_id, x.target_id, coalesce(x.loc_file, n.file) AS file, coalesce(x.loc_line, n.start_line) AS line FROM (
SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY place) AS k FROM (SELECT *, CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS place FROM (
SELECT * FROM g_edges WHERE type = 'USES' AND target_id IN (SELECT 'n:0' UNION ALL SELECT node_id FROM g_anc WHERE ancestor_id = 'n:0') ORDER BY {_ORDER} LIMIT 100))) x JOIN g_nodes n ON n.node_id = x.source_id WHERE k = 1"""), "g_edges", "g_nodes", "g_anc", "g_refs", "g_near_class"))  # fmt: skip
def flagship(g):
    """Member-expanded usages of a class, ranked and limited, with how and from which class each one refers."""
    u = S.usages_members(g, "n:0").drop("source_fqn")
    u = g.keep(u, "flagship")  # a hundred rows: references are made for these alone
    r = g.refs_among(u).where("type = 'USES'").select("source_id", "target_id", "ref_type")
    c = g.class_of("Method", "Function", "Argument", "Property").select(F.col("node_id").alias("source_id"), F.col("owner_id").alias("class_id"))
    return u.join(r, ["source_id", "target_id"]).join(c, "source_id", "left").select("place", "source_id", "target_id", "file", "line", "ref_type", "class_id")


def entries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, sf_dir) -> DataFrame."""
    return {name: (lambda spark, sf_dir, f=f: f(projected(spark, sf_dir))) for name, f in QUERIES.items()}


# --- details ---

from .operators import details as T  # noqa: E402
from .operators.reconcile import without_orphans  # noqa: E402
from .streaming.reconcile import emit_counts  # noqa: E402

query("override_methods", sql("SELECT e.source_id AS method_id, e.target_id AS parent_id, a.source_id AS class_id, b.source_id AS parent_class_id FROM g_edges e JOIN g_edges a ON a.type = 'CONTAINS' AND a.target_id = e.source_id JOIN g_edges b ON b.type = 'CONTAINS' AND b.target_id = e.target_id WHERE e.type = 'OVERRIDES'", "g_edges"))(lambda g: T.override_methods(g).select("method_id", "parent_id", "class_id", "parent_class_id"))
query("interface_methods", sql("SELECT i.node_id AS interface_id, m.node_id AS method_id, m.name AS method_name FROM g_nodes i JOIN g_edges e ON e.type = 'CONTAINS' AND e.source_id = i.node_id JOIN g_nodes m ON m.node_id = e.target_id AND m.kind = 'Method' WHERE i.kind = 'Interface'", "g_nodes", "g_edges"))(lambda g: T.interface_methods(g).select("interface_id", "method_id", "method_name"))
query("signature_types", sql("SELECT m.node_id AS method_id, t.node_id AS type_id, t.name AS type_name, c.source_id AS class_id FROM g_nodes m JOIN g_edges e ON e.type = 'TYPE_HINT' AND e.source_id = m.node_id JOIN g_nodes t ON t.node_id = e.target_id JOIN g_edges c ON c.type = 'CONTAINS' AND c.target_id = m.node_id WHERE m.kind = 'Method'", "g_nodes", "g_edges"))(lambda g: T.signature_types(g).select("method_id", "type_id", "type_name", "class_id"))
query("source_chains", sql("""SELECT a.source_id AS call_id, a.position, a.target_id AS value_id, p.source_id AS source_call_id, CASE WHEN c.callee_kind IN ('Method', 'Function') THEN concat(c.callee_name, '()') ELSE c.callee_name END AS made_by,
CASE c.call_kind WHEN 'method' THEN 'method_call' WHEN 'method_static' THEN 'static_call' WHEN 'constructor' THEN 'instantiation' WHEN 'access' THEN 'property_access' WHEN 'access_static' THEN 'static_property' WHEN 'function' THEN 'function_call' END AS ref_type FROM g_edges a JOIN g_edges p ON p.type = 'PRODUCES' AND p.target_id = a.target_id JOIN g_callfact c ON c.call_id = p.source_id WHERE a.type = 'ARGUMENT'""", "g_edges", "g_callfact"))(lambda g: T.source_chains(g).select("call_id", "position", "value_id", "source_call_id", "made_by", "ref_type"))  # fmt: skip
query("argument_keys", sql("SELECT a.source_id AS call_id, a.target_id AS value_id, replace(a.parameter, '::__construct().', '::') AS key, a.expression AS shown, v.value_kind FROM g_edges a JOIN g_nodes v ON v.node_id = a.target_id WHERE a.type = 'ARGUMENT'", "g_edges", "g_nodes"))(T.argument_keys)
_DEPS = f"deps AS (SELECT c.source_id AS class_id, u.source_id AS member_id, u.target_id FROM g_edges u JOIN g_nodes m ON m.node_id = u.source_id AND m.kind IN ('Method', 'Property') JOIN g_edges c ON c.type = 'CONTAINS' AND c.target_id = u.source_id WHERE u.type = 'USES' AND NOT EXISTS ({_INSIDE.format('u.target_id', 'c.source_id')}))"
_TC = f"tc AS (SELECT t.target_id, CASE WHEN n.kind IN {_TYPES} THEN t.target_id ELSE o.node_id END AS class_id FROM (SELECT DISTINCT target_id FROM g_edges WHERE type = 'USES') t JOIN g_nodes n ON n.node_id = t.target_id LEFT JOIN (SELECT e.target_id, c.node_id FROM g_edges e JOIN g_nodes c ON c.node_id = e.source_id AND c.kind IN {_TYPES} WHERE e.type = 'CONTAINS') o ON o.target_id = t.target_id)"
query("member_dependencies", sql("SELECT class_id, member_id, target_id FROM deps", "g_edges", "g_nodes", "g_anc", ctes=_DEPS))(lambda g: T.member_dependencies(g).select("class_id", "member_id", "target_id"))
query("constructor_targets", sql("SELECT DISTINCT c.scope_id, k.source_id AS class_id FROM g_callfact c JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = c.callee_id WHERE c.call_kind = 'constructor'", "g_callfact", "g_edges"))(T.constructor_targets)
query("target_classes", sql("SELECT target_id, class_id FROM tc WHERE class_id IS NOT NULL", "g_edges", "g_nodes", ctes=_TC))(T.target_classes)
query("merged_sites", sql("""SELECT n.owner_id AS class_id, c.callee_id, count(*) AS n, string_agg(concat(c.scope_id, ':', coalesce(CAST(c.call_line AS VARCHAR), '?')), ',' ORDER BY concat(c.scope_id, ':', coalesce(CAST(c.call_line AS VARCHAR), '?'))) AS sites, CASE WHEN count(*) = 1 THEN min(c.call_line) END AS line
FROM g_callfact c JOIN g_near_class n ON n.node_id = c.call_id WHERE c.callee_id IS NOT NULL GROUP BY 1, 2""", "g_callfact", "g_near_class"))(T.merged_sites)  # fmt: skip
query("access_counts", sql("SELECT target_id AS property_id, count(*) AS accesses, count(DISTINCT source_id) AS methods FROM g_refs WHERE ref_type = 'property_access' GROUP BY 1", "g_refs"))(T.access_counts)
query("return_flows", sql("SELECT e.target_id AS result_id, e.source_id AS local_id, coalesce(a.target_id = b.target_id, false) AS type_ok FROM g_edges e LEFT JOIN g_edges a ON a.type = 'TYPE_OF' AND a.source_id = e.source_id LEFT JOIN g_edges b ON b.type = 'TYPE_OF' AND b.source_id = e.target_id WHERE e.type = 'ASSIGNED_FROM'", "g_edges"))(T.return_flows)
query("class_expansion", sql("SELECT node_id, min(depth) AS depth FROM walk GROUP BY node_id HAVING min(depth) > 0", "g_edges", "g_nodes", "g_anc",
    ctes=f"{_DEPS}, {_TC}, hop AS (SELECT source_id AS a, target_id AS b FROM g_edges WHERE type = 'EXTENDS' UNION SELECT d.class_id, t.class_id FROM deps d JOIN tc t ON t.target_id = d.target_id WHERE t.class_id IS NOT NULL), walk AS (SELECT 'n:3' AS node_id, CAST(0 AS BIGINT) AS depth UNION SELECT h.b, w.depth + 1 FROM walk w JOIN hop h ON h.a = w.node_id WHERE w.depth < 2)"))(lambda g: T.class_expansion(g, "n:3"))
query("ranked_references", sql(f"SELECT target_id, count(*) AS n, CAST(min({_PRIORITY}) AS BIGINT) AS best, count(DISTINCT ref_type) AS kinds FROM g_refs GROUP BY 1", "g_refs"))(T.ranked_references)
query("calls_at_line", sql("SELECT source_id, target_id, loc_line, call_id FROM sites", "g_edges", "g_callfact", ctes=_AT))(lambda g: C.reference_calls(g).select("source_id", "target_id", "loc_line", "call_id"))
query("methods_in_order", sql("SELECT e.source_id AS class_id, count(*) AS n, string_agg(m.node_id, ',' ORDER BY m.start_line, m.node_id) AS methods FROM g_edges e JOIN g_nodes m ON m.node_id = e.target_id AND m.kind = 'Method' WHERE e.type = 'CONTAINS' GROUP BY 1", "g_edges", "g_nodes"))(T.methods_in_order)


def _texts(g):
    return g.source.table("documents").select(F.concat(F.lit("c:"), "doc_id").alias("node_id"), "text")


query("whole_chunks", sql(f"SELECT n.node_id, n.kind, CAST(length({_CUT}) AS BIGINT) AS chars, length(text) > 400 AS cut FROM documents d JOIN g_nodes n ON n.node_id = concat('c:', d.doc_id)", "g_nodes"))(lambda g: T.whole_chunks(g.nodes.select("node_id", "kind"), _texts(g), 100))
query("class_prefix", "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:20], chr(10))) AS prefix_md5 FROM documents")(lambda g: T.class_prefixes(g.source.table("documents")))
query("find_message", sql("SELECT id, sources, targets FROM (SELECT s.id, s.sources, coalesce(t.targets, 0) AS targets FROM (SELECT to_id AS id, count(DISTINCT flow_id) AS sources FROM g_emits WHERE to_label = 'Message' GROUP BY 1) s LEFT JOIN (SELECT from_id, count(DISTINCT flow_id) AS targets FROM g_handled_by GROUP BY 1) t ON t.from_id = s.id) WHERE contains(lower(id), 'ic') ORDER BY id LIMIT 50", *_F))(lambda g: W.find(W.list_entities(g, "Message"), "id", [], "IC"))
query("legacy_sweep", sql("SELECT type, count(*) AS n FROM g_edges WHERE type <> 'OVERRIDES' GROUP BY 1", "g_edges"))(lambda g: _n(g.edges.where("type <> 'OVERRIDES'"), "type"))
query("orphan_vectors", sql("SELECT collection, count(*) AS n FROM g_vectors WHERE CAST(substr(node_id, 3) AS BIGINT) % 5 <> 0 GROUP BY 1", "g_vectors"))(lambda g: _n(without_orphans(g.vectors, g.source.table("part").where("p_partkey % 5 = 0").select(F.concat(F.lit("p:"), "p_partkey").alias("node_id")), "node_id"), "collection"))
query("explanation_upsert", "SELECT concat('c:', c_custkey) AS node_id, CASE WHEN l.doc_id IS NOT NULL THEN concat('about ', c_custkey) END AS explanation, CASE WHEN l.doc_id IS NOT NULL THEN 'm' END AS explain_model FROM customer c LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = c.c_custkey")(
    lambda g: X.upsert_explanations(g.of_kind("Method").select("node_id"), g.source.table("labels").where("quality = 1").select(F.concat(F.lit("c:"), "doc_id").alias("node_id"), F.concat(F.lit("about "), "doc_id").alias("explanation")).distinct(), "m").select("node_id", "explanation", "explain_model")
)
query("event_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda g: emit_counts(g.source.table("events")).select(F.unix_timestamp(F.col("window.start")).alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
)

from . import registry_enrichment, registry_members, registry_values  # noqa: E402, F401
