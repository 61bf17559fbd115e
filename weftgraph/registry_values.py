"""Queries over the flow of values across methods, ordered trees, and the calls behind references."""

from __future__ import annotations

from .operators import lookups as L
from .operators import trees as T
from .operators import values as V
from .oracle import sql
from .registry import query

_CALLABLE = "('Method', 'Function')"
_CONSUMES = """consumes AS MATERIALIZED (SELECT value_id, call_id, min(via) AS via FROM (
SELECT r.target_id AS value_id, coalesce(a.source_id, r.source_id) AS call_id, CASE WHEN a.source_id IS NULL THEN 1 ELSE 0 END AS via FROM g_edges r
  LEFT JOIN g_edges p ON p.type = 'PRODUCES' AND p.source_id = r.source_id LEFT JOIN g_edges a ON a.type = 'ARGUMENT' AND a.target_id = p.target_id WHERE r.type = 'RECEIVER'
UNION ALL SELECT target_id, source_id, 2 FROM g_edges WHERE type = 'ARGUMENT') GROUP BY 1, 2)"""
_PARAMETERS = "parameters AS MATERIALIZED (SELECT fqn AS parameter, min(node_id) AS value_id FROM g_nodes WHERE kind = 'Value' AND value_kind = 'parameter' GROUP BY 1)"
_ONWARD = f"""onward AS MATERIALIZED (SELECT DISTINCT * FROM (
SELECT c.call_id, p.value_id AS next_id, NULL AS method_id, a.parameter AS label FROM g_callfact c JOIN g_edges a ON a.type = 'ARGUMENT' AND a.source_id = c.call_id JOIN parameters p ON p.parameter = a.parameter WHERE c.callee_kind IN {_CALLABLE}
UNION ALL SELECT call_id, local_id, NULL, NULL FROM g_callfact WHERE callee_kind IN {_CALLABLE} AND local_id IS NOT NULL
UNION ALL SELECT c.call_id, k.local_id, m.owner_id, CASE WHEN k.scope_kind IN {_CALLABLE} THEN k.scope_fqn END FROM g_callfact c JOIN g_edges t ON t.type = 'TYPE_OF' AND t.source_id = c.result_id
  JOIN g_near_method m ON m.node_id = c.call_id JOIN g_callfact k ON k.callee_id = m.owner_id AND k.local_type_id = t.target_id WHERE c.callee_kind IN {_CALLABLE} AND c.local_id IS NULL AND k.local_id IS NOT NULL))"""
_HOPS = "hops AS MATERIALIZED (SELECT DISTINCT c.value_id, o.next_id, o.method_id, o.label FROM consumes c JOIN onward o ON o.call_id = c.call_id WHERE c.via <> 1)"
_FLOW = """flow AS (SELECT node_id AS root_id, node_id AS value_id, CAST(1 AS BIGINT) AS level, CAST([] AS VARCHAR[]) AS methods, CAST(NULL AS VARCHAR) AS label FROM g_nodes WHERE kind = 'Value' AND value_kind = 'result'
UNION SELECT f.root_id, h.next_id, f.level + 1, CASE WHEN h.method_id IS NULL THEN f.methods ELSE list_sort(list_append(f.methods, h.method_id)) END, h.label FROM flow f JOIN hops h ON h.value_id = f.value_id
  WHERE f.level < 3 AND (h.method_id IS NULL OR len(f.methods) < 3 AND NOT list_contains(f.methods, h.method_id)))"""

query("value_flow", sql("""SELECT root_id, call_id, level, CAST(crossings AS BIGINT) AS crossings, crossed_from, ['receiver', 'access', 'argument'][via + 1] AS via FROM (
SELECT f.root_id, c.call_id, f.level, min(len(f.methods)) AS crossings, min(f.label) AS crossed_from, min(c.via) AS via, min(f.level) OVER (PARTITION BY f.root_id, c.call_id) AS least
FROM flow f JOIN consumes c ON c.value_id = f.value_id GROUP BY f.root_id, c.call_id, f.level) WHERE level = least""", "g_nodes", "g_edges", "g_callfact", "g_near_method",
    ctes=", ".join([_CONSUMES, _PARAMETERS, _ONWARD, _HOPS, _FLOW])))(V.value_flow)

_MADE = """made AS MATERIALIZED (SELECT DISTINCT v.node_id, p.source_id AS call_id FROM g_nodes v LEFT JOIN g_edges s ON s.type = 'ASSIGNED_FROM' AND s.source_id = v.node_id
JOIN g_edges p ON p.type = 'PRODUCES' AND p.target_id = coalesce(s.target_id, CASE WHEN v.value_kind = 'result' THEN v.node_id END) JOIN g_edges k ON k.type = 'CALLS' AND k.source_id = p.source_id
WHERE v.kind = 'Value' AND v.value_kind IS DISTINCT FROM 'parameter')"""
_GIVEN = """asked AS (SELECT result_id AS value_id, min(receiver_id) AS receiver_id FROM g_callfact WHERE result_id IS NOT NULL AND receiver_id IS NOT NULL GROUP BY 1),
given AS MATERIALIZED (SELECT DISTINCT a.source_id AS call_id, CASE WHEN v.value_kind = 'result' THEN q.receiver_id ELSE a.target_id END AS next_id FROM g_edges a JOIN g_nodes v ON v.node_id = a.target_id LEFT JOIN asked q ON q.value_id = a.target_id WHERE a.type = 'ARGUMENT'),
passed AS MATERIALIZED (SELECT p.value_id AS node_id, a.source_id AS call_id, a.target_id AS value_id FROM g_edges a JOIN parameters p ON p.parameter = a.parameter WHERE a.type = 'ARGUMENT'),
entries AS MATERIALIZED (SELECT * FROM made UNION SELECT node_id, call_id FROM passed),
pairs AS MATERIALIZED (SELECT m.node_id, g.next_id FROM made m JOIN given g ON g.call_id = m.call_id WHERE g.next_id IS NOT NULL UNION SELECT node_id, value_id FROM passed)"""
_BACK = "back AS (SELECT DISTINCT node_id AS root_id, node_id, CAST(1 AS BIGINT) AS level FROM entries UNION SELECT b.root_id, p.next_id, b.level + 1 FROM back b JOIN pairs p ON p.node_id = b.node_id WHERE b.level < 5)"
query("value_origin", sql("SELECT b.root_id AS value_id, e.call_id, min(b.level) AS level FROM back b JOIN entries e ON e.node_id = b.node_id GROUP BY 1, 2", "g_nodes", "g_edges", "g_callfact",
    ctes=", ".join([_MADE, _PARAMETERS, _GIVEN, _BACK])))(V.value_origin)

# trees in visiting order: SQL has no walk with a shared count; tests hold them against one
query("usages_tree")(lambda g: T.uses_trees(g, False))
query("deps_tree")(lambda g: T.uses_trees(g, True))

_PLACES = "places AS MATERIALIZED (SELECT DISTINCT e.source_id, e.target_id, e.loc_file, e.loc_line, coalesce(e.loc_file, n.file) AS file, coalesce(e.loc_line, n.start_line) AS at FROM g_edges e JOIN g_nodes n ON n.node_id = e.source_id WHERE e.type = 'USES')"
_FOUND = """found AS (
SELECT p.source_id, p.target_id, p.loc_file, p.loc_line, 1 AS strategy, c.call_id, abs(coalesce(c.call_line, 0) - coalesce(p.at, 0)) AS off FROM places p JOIN g_callfact c ON c.callee_id = p.target_id JOIN g_anc a ON a.node_id = c.call_id AND a.ancestor_id = p.source_id
UNION ALL SELECT p.source_id, p.target_id, p.loc_file, p.loc_line, 2, c.call_id, abs(c.call_line - p.at) FROM places p JOIN g_callfact c ON c.callee_id = p.target_id AND c.call_file = p.file WHERE c.call_line IS NOT NULL AND p.at IS NOT NULL
UNION ALL SELECT p.source_id, p.target_id, p.loc_file, p.loc_line, 3, c.call_id, abs(coalesce(c.call_line, 0) - coalesce(p.at, 0)) FROM places p JOIN g_edges k ON k.type = 'CONTAINS' AND k.source_id = p.target_id
  JOIN g_callfact c ON c.callee_id = k.target_id AND c.call_kind = 'constructor' AND c.callee_name = '__construct' JOIN g_anc a ON a.node_id = c.call_id AND a.ancestor_id = p.source_id)"""
query("nearest_call", sql("SELECT source_id, target_id, loc_file, loc_line, CAST(strategy AS BIGINT) AS strategy, call_id, CAST(off AS BIGINT) AS off FROM found QUALIFY row_number() OVER (PARTITION BY source_id, target_id, loc_file, loc_line ORDER BY strategy, off, call_id) = 1",
    "g_nodes", "g_edges", "g_callfact", "g_anc", ctes=f"{_PLACES}, {_FOUND}"))(L.nearest_call)
_FIRST = "arg_min({0}, (CASE WHEN c.call_line = r.loc_line THEN 0 ELSE 1 END, c.call_id)) FILTER (WHERE {0} IS NOT NULL)"
query("best_receiver", sql(f"""SELECT class_id, caller_id, property_id, loc_line, {_FIRST.format('receiver_name')} AS receiver, {_FIRST.format('receiver_value_kind')} AS receiver_kind, {_FIRST.format('on_symbol')} AS through FROM (
SELECT DISTINCT k.source_id AS class_id, e.source_id AS caller_id, e.target_id AS property_id, e.loc_line FROM g_edges e JOIN g_nodes p ON p.node_id = e.target_id AND p.kind = 'Property' JOIN g_nodes s ON s.node_id = e.source_id AND s.kind IN ('Method', 'Function')
  JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = e.target_id WHERE e.type = 'USES' AND NOT EXISTS (SELECT 1 FROM g_anc a WHERE a.node_id = e.source_id AND a.ancestor_id = k.source_id)) r
LEFT JOIN g_callfact c ON c.scope_id = r.caller_id AND c.callee_id = r.property_id AND c.callee_kind = 'Property' GROUP BY 1, 2, 3, 4""", "g_nodes", "g_edges", "g_callfact", "g_anc"))(L.best_receiver)  # fmt: skip

_REF = "CASE c.call_kind WHEN 'method' THEN 'method_call' WHEN 'method_static' THEN 'static_call' WHEN 'constructor' THEN 'instantiation' WHEN 'access' THEN 'property_access' WHEN 'access_static' THEN 'static_property' WHEN 'function' THEN 'function_call' END"
_ENTRIES = f"""consumed AS MATERIALIZED (SELECT DISTINCT p.source_id AS call_id FROM g_edges p JOIN g_nodes v ON v.node_id = p.target_id AND v.value_kind = 'result' JOIN g_edges u ON u.type IN ('RECEIVER', 'ARGUMENT') AND u.target_id = p.target_id AND u.source_id <> p.source_id
  JOIN g_callfact a ON a.call_id = p.source_id JOIN g_callfact b ON b.call_id = u.source_id AND b.scope_id = a.scope_id WHERE p.type = 'PRODUCES'),
shown AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY call_id) AS k FROM (SELECT c.*, {_REF} AS ref_type FROM g_callfact c WHERE c.scope_kind IN {_CALLABLE} AND c.call_id NOT IN (SELECT call_id FROM consumed)
  QUALIFY row_number() OVER (PARTITION BY c.scope_id, coalesce(c.callee_id, c.call_id) ORDER BY c.call_id) = 1)),
entry AS MATERIALIZED (SELECT s.scope_id, s.k, s.call_id, s.callee_id, s.local_id, s.ref_type, s.ref_type = 'property_access' AND s.local_id IS NULL AND s.on_expr IS NOT NULL AND EXISTS (SELECT 1 FROM g_edges x JOIN shown o ON o.call_id = x.source_id
  WHERE x.type = 'ARGUMENT' AND o.scope_id = s.scope_id AND contains(x.expression, concat(s.on_expr, '->', split_part(s.callee_fqn, '::$', 2)))) AS orphan FROM shown s)"""
_TREE = """tree AS (SELECT scope_id AS root_id, [k] AS path, [scope_id] AS seen, CAST(NULL AS VARCHAR) AS parent_id, call_id, callee_id, local_id, ref_type, orphan FROM entry WHERE callee_id IS DISTINCT FROM scope_id
UNION ALL SELECT t.root_id, list_append(t.path, e.k), list_append(t.seen, t.callee_id), t.call_id, e.call_id, e.callee_id, e.local_id, e.ref_type, e.orphan FROM tree t JOIN entry e ON e.scope_id = t.callee_id
  WHERE len(t.path) < 3 AND (e.callee_id IS NULL OR NOT list_contains(t.seen, e.callee_id) AND e.callee_id <> t.callee_id))"""
query("exec_flow_tree", sql("SELECT root_id, place, CAST(len(path) AS BIGINT) AS depth, parent_id, call_id, callee_id, local_id, ref_type FROM (SELECT *, CAST(row_number() OVER (PARTITION BY root_id ORDER BY path) AS BIGINT) AS place FROM tree) WHERE place <= 100 AND NOT orphan",
    "g_nodes", "g_edges", "g_callfact", ctes=f"{_ENTRIES}, {_TREE}"))(T.execution_trees)
