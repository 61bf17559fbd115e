"""Queries over definitions by kind, and over what is reached through properties."""

from __future__ import annotations

from .operators import context as C
from .operators import members as M
from .oracle import sql
from .registry import query

_NE = ("g_nodes", "g_edges")
_HINT = """hint AS (SELECT e.source_id AS node_id, arg_min(n.fqn, n.node_id) AS type_fqn, arg_min(n.name, n.node_id) AS type_name
FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type = 'TYPE_HINT' GROUP BY 1)"""
_PROMOTED = """promoted AS (SELECT e.source_id AS property_id, e.target_id AS parameter_id, v.fqn AS parameter FROM g_edges e JOIN g_nodes p ON p.node_id = e.source_id AND p.kind = 'Property'
JOIN g_nodes v ON v.node_id = e.target_id AND v.kind = 'Value' AND v.value_kind = 'parameter' AND contains(v.fqn, '__construct()') WHERE e.type = 'ASSIGNED_FROM')"""
_CHILD = "JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = {0} JOIN g_nodes u ON u.node_id = k.source_id AND u.kind IN {1}"
_CLASSES = "('Class', 'Trait', 'Enum')"

query("method_definitions", sql("""SELECT m.node_id, coalesce(a.arguments, '') AS arguments, h.type_fqn AS return_fqn, h.type_name AS return_name FROM g_nodes m LEFT JOIN hint h ON h.node_id = m.node_id
LEFT JOIN (SELECT k.source_id AS node_id, string_agg(concat(a.name, coalesce(concat(':', h.type_name), '')), ',' ORDER BY a.node_ord) AS arguments FROM g_nodes a JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = a.node_id
  LEFT JOIN hint h ON h.node_id = a.node_id WHERE a.kind = 'Argument' GROUP BY 1) a ON a.node_id = m.node_id WHERE m.kind IN ('Method', 'Function')""", *_NE, ctes=_HINT))(
    lambda g: M.method_definitions(g).fillna("", ["arguments"])
)
query("argument_definitions", sql("SELECT a.node_id, a.name, h.type_fqn, h.type_name FROM g_nodes a LEFT JOIN hint h ON h.node_id = a.node_id WHERE a.kind = 'Argument'", *_NE, ctes=_HINT))(M.argument_definitions)
_PROPERTY = "EXISTS (SELECT 1 FROM promoted x WHERE x.property_id = p.node_id) AS promoted FROM g_nodes p LEFT JOIN hint h ON h.node_id = p.node_id"
query("property_definitions", sql(f"SELECT p.node_id, p.name, h.type_fqn, h.type_name, {_PROPERTY} WHERE p.kind = 'Property'", *_NE, ctes=f"{_HINT}, {_PROMOTED}"))(
    lambda g: M.property_definitions(g).select("node_id", "name", "type_fqn", "type_name", "promoted")
)
_OF_CLASS = f"""SELECT k.source_id AS class_id, CAST(row_number() OVER (PARTITION BY k.source_id ORDER BY p.node_ord, p.node_id) AS BIGINT) AS place, p.node_id AS property_id, p.name, h.type_name, {_PROPERTY}
{_CHILD.format("p.node_id", _CLASSES)} WHERE p.kind = 'Property'"""
query("class_properties", sql(_OF_CLASS, *_NE, ctes=f"{_HINT}, {_PROMOTED}"))(lambda g: M.class_properties(g).select("class_id", "place", "property_id", "name", "type_name", "promoted"))
query("constructor_dependencies", sql(f"SELECT class_id, CAST(row_number() OVER (PARTITION BY class_id ORDER BY place) AS BIGINT) AS place, name, type_name FROM ({_OF_CLASS}) WHERE promoted", *_NE, ctes=f"{_HINT}, {_PROMOTED}"))(M.constructor_dependencies)
query("class_methods", sql(f"""SELECT class_id, CAST(row_number() OVER (PARTITION BY class_id ORDER BY CASE WHEN o THEN 0 ELSE 2 END, node_ord, method_id) AS BIGINT) AS place, method_id, name, CASE WHEN o THEN 'override' ELSE '' END AS tags FROM (
SELECT k.source_id AS class_id, m.node_id AS method_id, m.name, m.node_ord, EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'OVERRIDES' AND e.source_id = m.node_id) AS o FROM g_nodes m {_CHILD.format("m.node_id", _CLASSES)}
WHERE m.kind = 'Method' AND m.name <> '__construct')""", *_NE))(lambda g: M.class_methods(g).select("class_id", "place", "method_id", "name", "tags"))  # fmt: skip
query("interface_definitions", sql("""SELECT i.node_id AS interface_id, coalesce(m.methods, '') AS methods, x.extends FROM g_nodes i
LEFT JOIN (SELECT k.source_id, string_agg(m.name, ',' ORDER BY m.node_ord, m.name) AS methods FROM g_edges k JOIN g_nodes m ON m.node_id = k.target_id AND m.kind = 'Method' WHERE k.type = 'CONTAINS' GROUP BY 1) m ON m.source_id = i.node_id
LEFT JOIN (SELECT e.source_id, arg_min(n.fqn, n.node_id) AS extends FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type = 'EXTENDS' GROUP BY 1) x ON x.source_id = i.node_id WHERE i.kind = 'Interface'""", *_NE))(
    lambda g: M.interface_definitions(g).fillna("", ["methods"])
)
_SHOWN = "CASE WHEN {0}.callee_kind IN ('Method', 'Function') THEN concat({0}.callee_name, '()') WHEN {0}.callee_kind = 'Property' AND NOT starts_with({0}.callee_name, '$') THEN concat('$', {0}.callee_name) ELSE {0}.callee_name END"
query("value_definitions", sql("""SELECT v.node_id, v.value_kind, t.fqn AS type_fqn, t.name AS type_name, CASE WHEN f.kind = 'Property' THEN f.fqn WHEN f.kind IS NOT NULL THEN m.fqn WHEN v.value_kind = 'result' THEN r.fqn END AS source_fqn,
CASE WHEN f.kind = 'Property' THEN concat('promotes to ', f.fqn) WHEN f.kind IS NOT NULL THEN m.shown WHEN v.value_kind = 'result' THEN r.shown END AS source_name FROM g_nodes v
LEFT JOIN (SELECT e.source_id, string_agg(n.fqn, '|' ORDER BY n.node_id) AS fqn, string_agg(n.name, '|' ORDER BY n.node_id) AS name FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id WHERE e.type = 'TYPE_OF' GROUP BY 1) t ON t.source_id = v.node_id
LEFT JOIN (SELECT source_id, min(target_id) AS from_id FROM g_edges WHERE type = 'ASSIGNED_FROM' GROUP BY 1) a ON a.source_id = v.node_id LEFT JOIN g_nodes f ON f.node_id = a.from_id
LEFT JOIN made m ON m.value_id = a.from_id LEFT JOIN made r ON r.value_id = v.node_id WHERE v.kind = 'Value'""", *_NE, "g_callfact",
    ctes=f"made AS (SELECT p.target_id AS value_id, arg_min(c.callee_fqn, c.call_id) AS fqn, arg_min({_SHOWN.format('c')}, c.call_id) AS shown FROM g_edges p JOIN g_callfact c ON c.call_id = p.source_id AND c.callee_id IS NOT NULL WHERE p.type = 'PRODUCES' GROUP BY 1)"))(M.value_definitions)

_REF = "CASE c.call_kind WHEN 'method' THEN 'method_call' WHEN 'method_static' THEN 'static_call' WHEN 'constructor' THEN 'instantiation' WHEN 'access' THEN 'property_access' WHEN 'access_static' THEN 'static_property' WHEN 'function' THEN 'function_call' END"
query("member_references", sql(f"SELECT c.call_id, c.callee_id, {_SHOWN.format('c')} AS shown, {_REF} AS ref_type, c.on_expr, c.on_kind, c.call_file AS file, c.call_line AS line FROM g_callfact c WHERE c.callee_id IS NOT NULL", "g_callfact"))(M.member_references)
_THROUGH = """through AS (SELECT p.node_id AS property_id, k.source_id AS class_id, c.call_id, c.callee_id, c.scope_id AS method_id FROM g_nodes p JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = p.node_id
JOIN g_callfact c ON c.on_symbol = p.fqn AND c.callee_id IS NOT NULL JOIN g_edges s ON s.type = 'CONTAINS' AND s.target_id = c.scope_id AND s.source_id = k.source_id WHERE p.kind = 'Property')"""
query("calls_through_properties", sql("SELECT property_id, class_id, call_id, callee_id, method_id FROM through", *_NE, "g_callfact", ctes=_THROUGH))(M.calls_through_properties)
query("contract_calls", sql("""SELECT h.target_id AS interface_id, t.property_id, t.call_id, t.callee_id FROM through t JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = t.property_id JOIN g_nodes i ON i.node_id = h.target_id AND i.kind = 'Interface'
JOIN g_nodes n ON n.node_id = t.callee_id WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.interface_id = h.target_id) OR EXISTS (SELECT 1 FROM declared d WHERE d.interface_id = h.target_id AND d.name = n.name)""", *_NE, "g_callfact",
    ctes=f"{_THROUGH}, declared AS (SELECT k.source_id AS interface_id, m.name FROM g_edges k JOIN g_nodes m ON m.node_id = k.target_id AND m.kind = 'Method' WHERE k.type = 'CONTAINS')"))(M.contract_calls)
_UP = """up AS (SELECT source_id AS node_id, target_id AS ancestor_id FROM g_edges WHERE type IN {0} UNION SELECT u.node_id, e.target_id FROM up u JOIN g_edges e ON e.type IN {0} AND e.source_id = u.ancestor_id)"""
query("interface_methods_of", sql("""SELECT DISTINCT m.node_id AS method_id, x.node_id AS interface_method_id FROM g_nodes m JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = m.node_id JOIN up ON up.node_id = k.source_id
JOIN g_nodes i ON i.node_id = up.ancestor_id AND i.kind = 'Interface' JOIN g_edges y ON y.type = 'CONTAINS' AND y.source_id = i.node_id JOIN g_nodes x ON x.node_id = y.target_id AND x.kind = 'Method' AND x.name = m.name WHERE m.kind = 'Method'""", *_NE,
    ctes=_UP.format("('EXTENDS', 'IMPLEMENTS')")))(M.interface_methods_of)
query("interface_children", sql("""SELECT interface_id, child_id, coalesce(m.n, 0) AS methods, coalesce(b.n, 0) AS children FROM kids LEFT JOIN (SELECT k.source_id, count(*) AS n FROM g_edges k JOIN g_nodes m ON m.node_id = k.target_id AND m.kind = 'Method' WHERE k.type = 'CONTAINS' GROUP BY 1) m ON m.source_id = child_id
LEFT JOIN (SELECT interface_id AS id, count(*) AS n FROM kids GROUP BY 1) b ON b.id = child_id""", *_NE,
    ctes="kids AS (SELECT e.target_id AS interface_id, e.source_id AS child_id FROM g_edges e JOIN g_nodes a ON a.node_id = e.source_id AND a.kind = 'Interface' JOIN g_nodes b ON b.node_id = e.target_id AND b.kind = 'Interface' WHERE e.type = 'EXTENDS')"))(M.interface_children)
query("supertype_members", sql("""SELECT DISTINCT k.source_id AS class_id, m.node_id AS member_id, 'override' AS how FROM g_nodes m JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = m.node_id WHERE m.kind = 'Method' AND m.name <> '__construct'
AND EXISTS (SELECT 1 FROM g_edges e WHERE e.type = 'OVERRIDES' AND e.source_id = m.node_id) UNION ALL SELECT ancestor_id, node_id, 'subclass' FROM up JOIN g_nodes c USING (node_id)""", *_NE, ctes=_UP.format("('EXTENDS')")))(M.supertype_members)  # fmt: skip
query("interface_uses", sql("""SELECT k.source_id AS interface_id, h.target_id AS used_id, min(CASE WHEN a.node_id IS NULL THEN 'return_type' ELSE 'parameter_type' END) AS ref_type FROM g_nodes i JOIN g_edges k ON k.type = 'CONTAINS' AND k.source_id = i.node_id
JOIN g_nodes m ON m.node_id = k.target_id AND m.kind = 'Method' JOIN (SELECT source_id AS method_id, target_id AS node_id, target_id AS hinted FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_id AND n.kind = 'Argument' WHERE e.type = 'CONTAINS'
UNION ALL SELECT node_id, NULL, node_id FROM g_nodes WHERE kind = 'Method') a ON a.method_id = m.node_id JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = a.hinted WHERE i.kind = 'Interface' GROUP BY 1, 2""", *_NE))(M.interface_uses)  # fmt: skip
query("property_inputs", sql("""SELECT p.property_id, p.parameter_id, c.call_id, a.value_id FROM promoted p JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = p.property_id JOIN g_edges m ON m.type = 'CONTAINS' AND m.source_id = k.source_id
JOIN g_callfact c ON c.callee_id = m.target_id AND c.call_kind = 'constructor' LEFT JOIN (SELECT source_id, parameter, min(target_id) AS value_id FROM g_edges WHERE type = 'ARGUMENT' GROUP BY 1, 2) a ON a.source_id = c.call_id AND a.parameter = p.parameter""", *_NE, "g_callfact", ctes=_PROMOTED))(M.property_inputs)  # fmt: skip
query("property_breakdown", sql("SELECT callee_id AS property_id, scope_id AS method_id, on_expr, on_kind, count(*) AS accesses, min(call_line) AS line FROM g_callfact WHERE callee_kind = 'Property' AND scope_kind IN ('Method', 'Function') GROUP BY 1, 2, 3, 4", "g_callfact"))(M.property_breakdown)

query("hinted_types", sql("""SELECT class_id, used_id, min(hint_line) AS hint_line, any_value(CASE rank WHEN 1 THEN 'property_type' WHEN 2 THEN 'parameter_type' ELSE 'return_type' END) AS hint FROM (
SELECT class_id, used_id, hint_line, rank, min(rank) OVER (PARTITION BY class_id, used_id) AS best FROM (
  SELECT k.source_id AS class_id, h.target_id AS used_id, m.start_line AS hint_line, CASE m.kind WHEN 'Property' THEN 1 ELSE 3 END AS rank FROM g_edges k JOIN g_nodes m ON m.node_id = k.target_id AND m.kind IN ('Property', 'Method')
  JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = m.node_id WHERE k.type = 'CONTAINS'
  UNION ALL SELECT k.source_id, h.target_id, a.start_line, 2 FROM g_edges k JOIN g_nodes m ON m.node_id = k.target_id AND m.kind = 'Method' JOIN g_edges c ON c.type = 'CONTAINS' AND c.source_id = m.node_id
  JOIN g_nodes a ON a.node_id = c.target_id AND a.kind = 'Argument' JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = a.node_id WHERE k.type = 'CONTAINS')) WHERE rank = best GROUP BY 1, 2""", *_NE))(C.hinted_types)  # fmt: skip
