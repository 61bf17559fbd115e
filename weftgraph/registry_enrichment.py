"""Queries over what models are asked about symbols and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import enrichment as E
from .oracle import sql
from .registry import query
from .schema import NODE_KINDS

_ND = "g_nodes", "g_edges"
_ASKED = "md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS chars, CAST({0} AS BIGINT) AS max_tokens"


def _digest(df: DataFrame) -> DataFrame:
    return df.select("id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("long").alias("chars"), F.col("max_tokens").cast("long").alias("max_tokens"))


def _sources(g) -> DataFrame:
    """The projection has no files: a stand-in for each symbol's source. Values and calls are no symbols: no prompt has theirs."""
    return g.of_kind(*[k for k in NODE_KINDS if k not in ("Value", "Call")]).select("node_id", F.concat(F.lit("source of "), "fqn").alias("source"))


def _level(k: int) -> str:
    """One level of a flow's walk: what is reached from the last one, first 12 in all."""
    before = " UNION ALL ".join(f"SELECT flow_id, k, node_id FROM l{i}" for i in range(k))
    return f"""l{k} AS (SELECT flow_id, had + row_number() OVER (PARTITION BY flow_id ORDER BY node_id) AS k, node_id FROM (
SELECT DISTINCT l.flow_id, e.target_id AS node_id, h.had FROM l{k - 1} l JOIN (SELECT flow_id, max(k) AS had FROM ({before}) GROUP BY 1) h ON h.flow_id = l.flow_id
JOIN uses e ON e.source_id = l.node_id WHERE NOT EXISTS (SELECT 1 FROM ({before}) s WHERE s.flow_id = l.flow_id AND s.node_id = e.target_id)) QUALIFY k <= 12)"""


_WALK = "uses AS (SELECT DISTINCT source_id, target_id FROM g_edges WHERE type = 'USES'), l0 AS (SELECT flow_id, 0 AS k, method_node_id AS node_id FROM g_flows WHERE method_node_id IS NOT NULL), " + ", ".join(
    _level(k) for k in (1, 2, 3)
)
_WALKED = "SELECT flow_id, CAST(k AS BIGINT) AS k, node_id FROM l1 UNION ALL SELECT flow_id, CAST(k AS BIGINT), node_id FROM l2 UNION ALL SELECT flow_id, CAST(k AS BIGINT), node_id FROM l3"
query("flow_context", sql(_WALKED, "g_flows", "g_edges", ctes=_WALK))(E.flow_walk)

_PART = "CASE WHEN {1} <> '' THEN concat('{0}: ', {1}) END"
query("symbol_prompts", sql(f"""SELECT id, {_ASKED.format(1024)} FROM (SELECT n.node_id AS id, concat_ws(chr(10) || chr(10), CASE n.kind WHEN 'Method' THEN '{E.TASKS["Method"].instruction}' ELSE '{E.TASKS["Class"].instruction}' END,
{_PART.format("Symbol", "n.fqn")}, {_PART.format("Declared in", "p.fqn")}, {_PART.format("Types", "t.types")}, {_PART.format("Used by", "u.users")}, concat('Source:', chr(10), 'source of ', n.fqn)) AS prompt FROM g_nodes n
LEFT JOIN (SELECT e.target_id, m.fqn FROM g_edges e JOIN g_nodes m ON m.node_id = e.source_id AND m.kind IN ('Class', 'Interface', 'Trait', 'Enum') WHERE e.type = 'CONTAINS') p ON p.target_id = n.node_id
LEFT JOIN (SELECT e.source_id, string_agg(DISTINCT m.fqn, ',' ORDER BY m.fqn) AS types FROM g_edges e JOIN g_nodes m ON m.node_id = e.target_id WHERE e.type = 'TYPE_HINT' GROUP BY 1) t ON t.source_id = n.node_id
LEFT JOIN (SELECT f.target_id, string_agg(m.fqn, ', ' ORDER BY f.k) AS users FROM (SELECT target_id, source_id, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS k FROM (SELECT DISTINCT target_id, source_id FROM g_edges WHERE type = 'USES') QUALIFY k <= 5) f
  JOIN g_nodes m ON m.node_id = f.source_id JOIN g_nodes c ON c.node_id = f.target_id AND c.kind IN ('Class', 'Interface') GROUP BY 1) u ON u.target_id = n.node_id WHERE n.kind IN ('Method', 'Class'))""", *_ND))(
    lambda g: _digest(E.symbol_prompts(g, _sources(g)))
)
_LISTS = ", ".join(
    f"{name} AS (SELECT flow_id, string_agg(DISTINCT {other}, ', ' ORDER BY {other}) AS names FROM {table} WHERE {label} = '{kind}' GROUP BY 1)"
    for name, table, label, other, kind in (("sends", "g_emits", "to_label", "to_id", "Message"), ("raises", "g_emits", "to_label", "to_id", "Event"), ("handles", "g_handled_by", "from_label", "from_id", "Message"), ("hears", "g_handled_by", "from_label", "from_id", "Event"))
)
query("flow_prompts", sql(f"""SELECT id, {_ASKED.format(512)} FROM (SELECT f.flow_id AS id, concat_ws(chr(10) || chr(10), '{E.TASKS["Flow"].instruction}', {_PART.format("Flow", "f.flow_id")}, {_PART.format("Type", "f.type")}, {_PART.format("Entry", "m.fqn")},
{_PART.format("Started by messages", "h.names")}, {_PART.format("Started by events", "v.names")}, {_PART.format("Sends messages", "s.names")}, {_PART.format("Raises events", "r.names")},
CASE WHEN m.fqn IS NOT NULL THEN concat('Source:', chr(10), 'source of ', m.fqn) END, concat('Uses:', chr(10), w.near)) AS prompt FROM g_flows f LEFT JOIN g_nodes m ON m.node_id = f.method_node_id
LEFT JOIN (SELECT x.flow_id, string_agg(concat('source of ', n.fqn), chr(10) || chr(10) ORDER BY x.k) AS near FROM ({_WALKED}) x JOIN g_nodes n ON n.node_id = x.node_id GROUP BY 1) w ON w.flow_id = f.flow_id
LEFT JOIN handles h ON h.flow_id = f.flow_id LEFT JOIN hears v ON v.flow_id = f.flow_id LEFT JOIN sends s ON s.flow_id = f.flow_id LEFT JOIN raises r ON r.flow_id = f.flow_id)""",
    "g_flows", "g_emits", "g_handled_by", *_ND, ctes=f"{_WALK}, {_LISTS}"))(lambda g: _digest(E.flow_prompts(g, _sources(g))))


def _named_flows(g) -> DataFrame:
    """Flows as documents name them; every second has lost its edge, every third its method's name."""
    m = g.of_kind("Method").select(F.col("node_id").alias("method_node_id"), F.col("name").alias("method"))
    c = F.col("user_id")
    up = g.containing("Method").select(F.col("target_id").alias("method_node_id"), F.col("source_id").alias("node_id")).join(g.ends("source", "CONTAINS").select("node_id", F.col("fqn").alias("entry_fqn")), "node_id").drop("node_id")
    rows = g.flows.join(m, "method_node_id").join(up, "method_node_id", "left")
    return rows.select("flow_id", F.when(c % 2 == 0, F.col("method_node_id")).alias("method_node_id"), "entry_fqn", F.when(c % 3 == 0, "").otherwise(F.col("method")).alias("entry_method"))


query("flow_entry_methods", sql("""SELECT flow_id, coalesce(method_node_id, m.node_id, c.node_id) AS node_id, CASE WHEN method_node_id IS NOT NULL THEN 'edge' WHEN m.node_id IS NOT NULL THEN 'method' WHEN c.node_id IS NOT NULL THEN 'class' END AS found_by
FROM (SELECT f.flow_id, CASE WHEN f.user_id % 2 = 0 THEN f.method_node_id END AS method_node_id, p.fqn AS entry_fqn, CASE WHEN f.user_id % 3 = 0 THEN '' ELSE n.name END AS entry_method FROM g_flows f JOIN g_nodes n ON n.node_id = f.method_node_id
  LEFT JOIN g_edges k ON k.type = 'CONTAINS' AND k.target_id = n.node_id LEFT JOIN g_nodes p ON p.node_id = k.source_id) f
LEFT JOIN named m ON m.fqn = concat(f.entry_fqn, '::', f.entry_method, '()') LEFT JOIN named c ON c.fqn = f.entry_fqn""", "g_flows", *_ND,
    ctes="named AS (SELECT fqn, arg_min(node_id, node_ord) AS node_id FROM g_nodes WHERE kind IN ('Method', 'Function', 'Class', 'Interface', 'Trait', 'Enum') GROUP BY 1)"))(lambda g: E.entry_methods(_named_flows(g), g.of_kind("Method", "Function", "Class", "Interface", "Trait", "Enum")))
