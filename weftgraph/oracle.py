"""SQL for checking: the projected graph and its derived tables as common table expressions.

The same tables that sources/projection.py and plans/ build in Spark, written once more in SQL, so that
each query has an independent counterpart.
"""

from __future__ import annotations

import re

EDGE_TYPES = ["CONTAINS", "USES", "USES_TRAIT", "TYPE_HINT", "TYPE_OF", "ARGUMENT", "ASSIGNED_FROM", "CALLS", "RECEIVER", "PRODUCES", "EXTENDS", "IMPLEMENTS", "OVERRIDES"]

VIEWS: dict[str, tuple[str, list[str]]] = {
    "g_values": (
        r"""SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS rn
FROM lineitem""",
        [],
    ),
    "g_class": (
        r"""SELECT n_nationkey, n_name, r_name, concat('App', chr(92), r_name, chr(92), n_name) AS fqn
FROM nation JOIN region ON n_regionkey = r_regionkey""",
        [],
    ),
    "g_nodes": (
        r"""SELECT CAST(r_regionkey AS BIGINT) AS node_ord, concat('r:', r_regionkey) AS node_id, 'File' AS kind, r_name AS name, r_name AS fqn,
       concat(r_name, '.php') AS file, CAST(0 AS BIGINT) AS start_line, CAST(NULL AS VARCHAR(20)) AS call_kind, CAST(NULL AS VARCHAR(20)) AS value_kind FROM region
UNION ALL SELECT 100000000 + n_nationkey, concat('n:', n_nationkey), CASE WHEN n_nationkey % 5 = 4 THEN 'Interface' ELSE 'Class' END, n_name, fqn,
       concat(r_name, '.php'), CAST(n_nationkey AS BIGINT), NULL, NULL FROM g_class
UNION ALL SELECT 200000000 + c_custkey, concat('c:', c_custkey), 'Method', CASE WHEN c_custkey % 10 = 0 THEN '__construct' ELSE c_name END,
       concat(fqn, '::', CASE WHEN c_custkey % 10 = 0 THEN '__construct' ELSE c_name END, '()'), concat(r_name, '.php'), c_custkey, NULL, NULL
       FROM customer JOIN g_class ON c_nationkey = n_nationkey
UNION ALL SELECT 300000000 + s_suppkey, concat('s:', s_suppkey), 'Property', concat('$', s_name), concat(fqn, '::$', s_name), concat(r_name, '.php'), s_suppkey, NULL, NULL
       FROM supplier JOIN g_class ON s_nationkey = n_nationkey
UNION ALL SELECT 400000000 + p_partkey, concat('p:', p_partkey), CASE WHEN p_size <= 5 THEN 'Interface' WHEN p_size = 6 THEN 'Trait' WHEN p_size = 7 THEN 'Enum' ELSE 'Class' END, p_name,
       concat('App', chr(92), p_brand, chr(92), p_name, '_', p_partkey), concat(p_brand, '.php'), p_partkey, NULL, NULL FROM part
UNION ALL SELECT 500000000 + o_orderkey, concat('o:', o_orderkey), 'Call', concat('call', o_orderkey), concat('call', o_orderkey), o_orderpriority, o_orderkey % 1000,
       CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'method_static' ELSE 'method' END WHEN 'O' THEN CASE WHEN o_orderkey % 6 = 0 THEN 'function' ELSE 'constructor' END
         ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'access_static' ELSE 'access' END END, NULL FROM orders
UNION ALL SELECT 150000000 + n_nationkey, concat('f:', n_nationkey), 'Function', concat('fn_', n_name), concat('App', chr(92), 'fn_', n_name), concat(r_name, '.php'), n_nationkey, NULL, NULL FROM g_class
UNION ALL SELECT 600000000 + c_custkey, concat('a:', c_custkey), 'Argument', '$p0', concat(fqn, '::', CASE WHEN c_custkey % 10 = 0 THEN '__construct' ELSE c_name END, '().$p0'), concat(r_name, '.php'), c_custkey, NULL, NULL
       FROM customer JOIN g_class ON c_nationkey = n_nationkey WHERE c_custkey % 4 = 0
UNION ALL SELECT 700000000 + s_suppkey, concat('w:', s_suppkey), 'Value', concat('$', s_name), concat(fqn, '::__construct().$', s_name), concat(r_name, '.php'), s_suppkey, NULL, 'parameter'
       FROM supplier JOIN g_class ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0
UNION ALL SELECT 800000000 + c_custkey, concat('q:', c_custkey), 'Value', '$p0', concat('c:', c_custkey, '.$p0'), concat(r_name, '.php'), c_custkey, NULL, 'parameter'
       FROM customer JOIN g_class ON c_nationkey = n_nationkey WHERE c_custkey % 4 = 0
UNION ALL SELECT 1000000000 + l_orderkey * 1000 + rn, concat('v:', l_orderkey, ':', rn), 'Value', concat('$v', rn), concat('call', l_orderkey, '::$v', rn), NULL, rn, NULL,
       CASE l_returnflag WHEN 'A' THEN 'parameter' WHEN 'N' THEN 'local' ELSE 'result' END FROM g_values""",
        ['g_values', 'g_class'],
    ),
    "g_calls": (
        r"""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       CASE WHEN o_orderstatus = 'P' THEN concat('s:', o_orderkey % ((SELECT count(*) FROM supplier) // 2) * 2)
         WHEN o_orderstatus = 'O' AND o_orderkey % 6 = 0 THEN concat('f:', o_orderkey % 25) ELSE concat('c:', o_orderkey % (SELECT count(*) FROM customer)) END AS callee_id
FROM orders""",
        [],
    ),
    "g_edges": (
        r"""SELECT 'CONTAINS' AS type, concat('r:', n_regionkey) AS source_id, concat('n:', n_nationkey) AS target_id, CAST(NULL AS VARCHAR(100)) AS loc_file, CAST(NULL AS BIGINT) AS loc_line, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR(100)) AS expression, CAST(NULL AS VARCHAR(200)) AS parameter FROM nation
UNION ALL SELECT 'CONTAINS', concat('n:', c_nationkey), concat('c:', c_custkey), NULL, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'CONTAINS', concat('n:', s_nationkey), concat('s:', s_suppkey), NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'CONTAINS', concat('c:', o_custkey), concat('o:', o_orderkey), NULL, NULL, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'CONTAINS', concat('c:', o_custkey), concat('v:', l_orderkey, ':', rn), NULL, NULL, NULL, NULL, NULL FROM g_values JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'USES', concat('c:', o_custkey), concat('s:', l_suppkey), CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('f', l_suppkey % 7) END, min(l_orderkey), NULL, NULL, NULL FROM g_values JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 2 = 1 GROUP BY o_custkey, l_suppkey
UNION ALL SELECT 'USES', concat('c:', o_custkey), concat('p:', l_partkey), concat('f', l_partkey % 7), min(l_orderkey), NULL, NULL, NULL FROM g_values JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
UNION ALL SELECT 'USES', concat('c:', o_custkey), callee_id, arg_min(o_orderpriority, o_orderkey), min(o_orderkey) % 1000, NULL, NULL, NULL FROM g_calls GROUP BY o_custkey, callee_id
UNION ALL SELECT 'CONTAINS', concat('r:', n_regionkey), concat('f:', n_nationkey), NULL, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'CONTAINS', concat('c:', c_custkey), concat('a:', c_custkey), NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'TYPE_HINT', concat('a:', c_custkey), concat('p:', c_custkey * 7 % (SELECT count(*) FROM part)), NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'USES', concat('a:', c_custkey), concat('p:', c_custkey * 7 % (SELECT count(*) FROM part)), 'arg', c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'ARGUMENT', concat('o:', o_orderkey), concat('v:', l_orderkey, ':', rn), NULL, NULL, 50 + rn, concat('$v', rn), concat(callee_id, '.$p', 50 + rn) FROM g_values JOIN g_calls ON l_orderkey + 1 = o_orderkey WHERE l_returnflag = 'R' AND l_orderkey % 4 = 0
UNION ALL SELECT 'CONTAINS', concat('c:', c_custkey), concat('q:', c_custkey), NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'TYPE_OF', concat('q:', c_custkey), concat('p:', c_custkey * 7 % (SELECT count(*) FROM part)), NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'ARGUMENT', concat('o:', o_orderkey), concat('q:', o_custkey), NULL, NULL, 40, '$p0', concat(callee_id, '.$p0') FROM g_calls WHERE o_custkey % 4 = 0 AND o_orderkey % 3 = 0
UNION ALL SELECT 'ASSIGNED_FROM', concat('s:', s_suppkey), concat('w:', s_suppkey), NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'TYPE_OF', concat('w:', s_suppkey), concat('p:', s_suppkey % (SELECT count(*) FROM part)), NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'USES_TRAIT', concat('p:', a.p_partkey), concat('p:', b.k), NULL, NULL, NULL, NULL, NULL FROM part a JOIN (SELECT p_brand AS brand, min(p_partkey) AS k FROM part WHERE p_size = 6 GROUP BY p_brand) b ON a.p_brand = b.brand WHERE a.p_size > 7 AND a.p_partkey % 3 = 0
UNION ALL SELECT 'CALLS', concat('o:', o_orderkey), callee_id, NULL, NULL, NULL, NULL, NULL FROM g_calls
UNION ALL SELECT 'RECEIVER', concat('o:', l_orderkey), concat('v:', l_orderkey, ':', rn), NULL, NULL, NULL, NULL, NULL FROM g_values WHERE rn = 1
UNION ALL SELECT 'ARGUMENT', concat('o:', l_orderkey), concat('v:', l_orderkey, ':', rn), NULL, NULL, rn - 1, concat('$v', rn), concat(callee_id, '.$p', rn - 1) FROM g_values JOIN g_calls ON l_orderkey = o_orderkey
UNION ALL SELECT 'PRODUCES', concat('o:', l_orderkey), concat('v:', l_orderkey, ':', rn), NULL, NULL, NULL, NULL, NULL FROM g_values WHERE l_returnflag = 'R'
UNION ALL SELECT 'ASSIGNED_FROM', concat('v:', a.l_orderkey, ':', a.rn), concat('v:', b.l_orderkey, ':', b.rn), NULL, NULL, NULL, NULL, NULL FROM g_values a JOIN g_values b ON a.l_orderkey = b.l_orderkey AND a.rn = b.rn + 1 WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R'
UNION ALL SELECT 'TYPE_OF', concat('v:', l_orderkey, ':', rn), concat('p:', l_partkey), NULL, NULL, NULL, NULL, NULL FROM g_values
UNION ALL SELECT 'TYPE_HINT', concat('s:', s_suppkey), concat('p:', s_suppkey % (SELECT count(*) FROM part)), NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'TYPE_HINT', concat('c:', c_custkey), concat('p:', c_custkey % (SELECT count(*) FROM part)), NULL, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'EXTENDS', concat('p:', p_partkey), concat('p:', CAST(floor((p_partkey - 1) / 2.0) AS BIGINT)), NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey > 0
UNION ALL SELECT 'IMPLEMENTS', concat('p:', a.p_partkey), concat('p:', b.k), NULL, NULL, NULL, NULL, NULL FROM part a JOIN (SELECT p_brand AS brand, min(p_partkey) AS k FROM part WHERE p_size <= 5 GROUP BY p_brand) b ON a.p_brand = b.brand WHERE a.p_size > 5
UNION ALL SELECT 'IMPLEMENTS', concat('n:', n_nationkey), concat('n:', n_nationkey - n_nationkey % 5 + 4), NULL, NULL, NULL, NULL, NULL FROM nation WHERE n_nationkey % 5 <> 4
UNION ALL SELECT 'OVERRIDES', concat('c:', c_custkey), concat('c:', CAST(floor((c_custkey - 1) / 2.0) AS BIGINT)), NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey > 0""",
        ['g_values', 'g_calls'],
    ),
    "g_flows": (
        r"""SELECT DISTINCT concat('flow:', CASE user_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'message' WHEN 2 THEN 'event' ELSE 'cli' END, ':', user_id) AS flow_id,
       CASE user_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'message' WHEN 2 THEN 'event' ELSE 'cli' END AS type, user_id,
       concat('n:', user_id % 25) AS class_node_id, concat('c:', user_id % (SELECT count(*) FROM customer)) AS method_node_id FROM events""",
        [],
    ),
    "g_emits": (
        r"""SELECT f.flow_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'Event' ELSE 'Message' END AS to_label,
       concat(CASE WHEN event_type IN ('purchase', 'error') THEN 'event:' ELSE 'message:' END, event_type) AS to_id,
       concat('o:', event_id % (SELECT count(*) FROM orders)) AS call_node_id, event_id FROM events e JOIN g_flows f ON e.user_id = f.user_id""",
        ['g_flows'],
    ),
    "g_handled_by": (
        r"""SELECT DISTINCT to_label AS from_label, to_id AS from_id, f.flow_id, f.user_id % 5 AS priority FROM g_emits m CROSS JOIN g_flows f WHERE f.user_id % 10 = length(m.to_id) % 10""",
        ['g_emits', 'g_flows'],
    ),
    "g_vectors": (
        r"""SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'code_embeddings' WHEN 1 THEN 'explain_embeddings' ELSE 'flow_explain_embeddings' END AS collection, concat('p:', vec_id % 100) AS node_id, embedding FROM embeddings""",
        [],
    ),
    "g_anc": (
        r"""SELECT target_id AS node_id, source_id AS ancestor_id, CAST(1 AS BIGINT) AS distance FROM g_edges WHERE type = 'CONTAINS'
UNION ALL SELECT a.node_id, e.source_id, a.distance + 1 FROM g_anc a JOIN g_edges e ON e.type = 'CONTAINS' AND e.target_id = a.ancestor_id""",
        ['g_edges'],
    ),
    "g_near_class": (
        r"""SELECT a.node_id, arg_min(a.ancestor_id, a.distance) AS owner_id, min(a.distance) AS distance FROM g_anc a JOIN g_nodes n ON n.node_id = a.ancestor_id
WHERE n.kind IN ('Class', 'Interface') GROUP BY a.node_id""",
        ['g_anc', 'g_nodes'],
    ),
    "g_near_method": (
        r"""SELECT a.node_id, arg_min(a.ancestor_id, a.distance) AS owner_id, min(a.distance) AS distance FROM g_anc a JOIN g_nodes n ON n.node_id = a.ancestor_id
WHERE n.kind = 'Method' GROUP BY a.node_id""",
        ['g_anc', 'g_nodes'],
    ),
    "g_hint_child": (
        r"""SELECT c.source_id AS up, c.target_id AS down, n.kind AS down_kind, h.target_id FROM g_edges c JOIN g_nodes n ON n.node_id = c.target_id AND n.kind IN ('Argument', 'Property')
JOIN g_edges h ON h.type = 'TYPE_HINT' AND h.source_id = c.target_id WHERE c.type = 'CONTAINS'""",
        ['g_edges', 'g_nodes'],
    ),
    "g_refs": (
        r"""SELECT e.type, e.source_id, e.target_id, e.loc_file, e.loc_line, s.kind AS source_kind, s.name AS source_name, s.fqn AS source_fqn, s.file AS source_file, s.start_line AS source_line,
  t.kind AS target_kind, t.name AS target_name, t.fqn AS target_fqn,
  CASE WHEN e.type IN ('EXTENDS', 'IMPLEMENTS', 'USES_TRAIT') THEN lower(e.type) WHEN t.kind = 'Method' THEN 'method_call' WHEN t.kind = 'Property' THEN 'property_access'
    WHEN t.kind IN ('Class', 'Interface', 'Trait', 'Enum') THEN CASE
      WHEN s.kind = 'Argument' THEN 'parameter_type' WHEN s.kind = 'Property' THEN 'property_type'
      WHEN s.kind IN ('Method', 'Function') THEN CASE
        WHEN EXISTS (SELECT 1 FROM g_hint_child h WHERE h.up = e.source_id AND h.target_id = e.target_id AND h.down_kind = 'Argument') THEN 'parameter_type'
        WHEN EXISTS (SELECT 1 FROM g_edges h WHERE h.type = 'TYPE_HINT' AND h.source_id = e.source_id AND h.target_id = e.target_id) THEN 'return_type'
        WHEN s.name = '__construct' AND EXISTS (SELECT 1 FROM g_hint_child h JOIN g_edges c ON c.type = 'CONTAINS' AND c.source_id = h.up WHERE c.target_id = e.source_id AND h.target_id = e.target_id AND h.down_kind = 'Property') THEN 'property_type'
        ELSE 'type_hint' END
      WHEN s.kind IN ('Class', 'Interface', 'Trait', 'Enum') AND EXISTS (SELECT 1 FROM g_hint_child h WHERE h.up = e.source_id AND h.target_id = e.target_id AND h.down_kind = 'Property') THEN 'property_type'
      ELSE 'type_hint' END
    WHEN t.kind = 'Function' THEN 'function_call' ELSE 'uses' END AS ref_type
FROM g_edges e JOIN g_nodes s ON s.node_id = e.source_id JOIN g_nodes t ON t.node_id = e.target_id WHERE e.type IN ('USES', 'EXTENDS', 'IMPLEMENTS', 'USES_TRAIT')""",
        ['g_edges', 'g_nodes', 'g_hint_child'],
    ),
    "g_callfact": (
        r"""SELECT c.node_id AS call_id, c.call_kind, c.file AS call_file, c.start_line AS call_line, ce.target_id AS callee_id, cn.kind AS callee_kind, cn.name AS callee_name, cn.fqn AS callee_fqn,
  sc.source_id AS scope_id, sn.kind AS scope_kind, sn.fqn AS scope_fqn, r.target_id AS receiver_id, rn.name AS receiver_name, rn.value_kind AS receiver_value_kind,
  p.result_id, l.local_id, y.target_id AS local_type_id,
  CASE WHEN rn.value_kind IS NULL THEN CASE WHEN c.call_kind IN ('access', 'method', 'method_static') THEN '$this' END WHEN rn.value_kind = 'self' THEN '$this' WHEN rn.value_kind = 'result' AND mn.name IS NOT NULL THEN
    concat(CASE WHEN mv.value_kind IN ('parameter', 'local') THEN mv.name ELSE '$this' END, '->', ltrim(mn.name, '$'), CASE WHEN mc.call_kind IN ('method', 'method_static') THEN '()' ELSE '' END) ELSE rn.name END AS on_expr,
  CASE WHEN rn.value_kind IS NULL THEN CASE WHEN c.call_kind IN ('access', 'method', 'method_static') THEN 'self' END WHEN rn.value_kind = 'parameter' THEN 'param' WHEN rn.value_kind = 'result' AND mn.name IS NOT NULL THEN 'property' ELSE rn.value_kind END AS on_kind,
  CASE WHEN rn.value_kind = 'result' THEN mn.fqn END AS on_symbol
FROM g_nodes c LEFT JOIN g_edges ce ON ce.type = 'CALLS' AND ce.source_id = c.node_id LEFT JOIN g_nodes cn ON cn.node_id = ce.target_id
LEFT JOIN g_edges sc ON sc.type = 'CONTAINS' AND sc.target_id = c.node_id LEFT JOIN g_nodes sn ON sn.node_id = sc.source_id
LEFT JOIN g_edges r ON r.type = 'RECEIVER' AND r.source_id = c.node_id LEFT JOIN g_nodes rn ON rn.node_id = r.target_id
LEFT JOIN (SELECT source_id, min(target_id) AS result_id FROM g_edges WHERE type = 'PRODUCES' GROUP BY source_id) p ON p.source_id = c.node_id
LEFT JOIN (SELECT target_id, min(source_id) AS local_id FROM g_edges WHERE type = 'ASSIGNED_FROM' GROUP BY target_id) l ON l.target_id = p.result_id
LEFT JOIN g_edges y ON y.type = 'TYPE_OF' AND y.source_id = l.local_id
LEFT JOIN g_edges mp ON mp.type = 'PRODUCES' AND mp.target_id = r.target_id LEFT JOIN g_nodes mc ON mc.node_id = mp.source_id LEFT JOIN g_edges ms ON ms.type = 'CALLS' AND ms.source_id = mp.source_id LEFT JOIN g_nodes mn ON mn.node_id = ms.target_id
LEFT JOIN g_edges mr ON mr.type = 'RECEIVER' AND mr.source_id = mp.source_id LEFT JOIN g_nodes mv ON mv.node_id = mr.target_id WHERE c.kind = 'Call'""",
        ['g_edges', 'g_nodes'],
    ),
    "g_dataflow": (
        r"""SELECT DISTINCT * FROM (
SELECT a.target_id AS source_id, p.target_id, 'argument' AS kind FROM g_edges a JOIN g_edges p ON p.type = 'PRODUCES' AND p.source_id = a.source_id WHERE a.type = 'ARGUMENT'
UNION ALL SELECT a.target_id, p.target_id, 'receiver' FROM g_edges a JOIN g_edges p ON p.type = 'PRODUCES' AND p.source_id = a.source_id WHERE a.type = 'RECEIVER'
UNION ALL SELECT target_id, source_id, 'assigned' FROM g_edges WHERE type = 'ASSIGNED_FROM') WHERE source_id <> target_id""",
        ['g_edges'],
    ),
}


_TYPE = re.compile(r"'(" + "|".join(EDGE_TYPES) + r")'")


def _edges_of(texts: list[str]) -> str:
    """g_edges with the branches that these texts can read: if each mention of it names types, those of the types named."""
    view = VIEWS["g_edges"][0]
    whole = " ".join(texts)
    mentions, tests = len(re.findall(r"\bg_edges\b", whole)), len(re.findall(r"\btype (?:=|IN)", whole))
    if tests < mentions or re.search(r"\btype (?:<>|NOT)", whole):
        return view
    named = set(_TYPE.findall(whole))
    own = [b for b in view.split("UNION ALL SELECT ") if _TYPE.search(b)[1] in named]
    return "UNION ALL SELECT ".join(own) if own and own[0].startswith("SELECT") else "SELECT '' AS type, '' AS source_id, '' AS target_id, '' AS loc_file, 0::BIGINT AS loc_line, 0::BIGINT AS position, '' AS expression, '' AS parameter WHERE false\nUNION ALL SELECT " + "UNION ALL SELECT ".join(own)


def sql(body: str, *views: str, ctes: str = "") -> str:
    """body over the views it names, with further common table expressions of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for d in VIEWS[name][1]:
            add(d)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if "g_edges" in order:
        views_of = {v: VIEWS[v][0] for v in order} | {"g_edges": _edges_of([body, ctes] + [VIEWS[v][0] for v in order if v != "g_edges"])}
    else:
        views_of = {v: VIEWS[v][0] for v in order}
    # each computed once, however often it is named; a recursive one can't be told so
    once = lambda v: "" if f"FROM {v} " in VIEWS[v][0] else "MATERIALIZED "
    parts = [f"{v} AS {once(v)}(\n{views_of[v]}\n)" for v in order] + ([ctes] if ctes else [])
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
