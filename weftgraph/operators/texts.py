"""Source text: line ranges, chunks within a token budget, and what enrichment needs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, MARKER, METHODS_NOTE, PREFIX_LINES, PREFIX_MARGIN, line_range, token_estimate, truncated
from ..graph import Graph


def source(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node_id, file, start_line, end_line and enclosing_*) with their source: the enclosing range
    where there is one, else the own range."""
    n = nodes.withColumn("s", F.coalesce("enclosing_start_line", "start_line")).withColumn("e", F.when(F.col("enclosing_start_line").isNotNull(), F.col("enclosing_end_line")).otherwise(F.coalesce("end_line", "start_line")))
    return n.join(files.select("file", "text"), "file").select("node_id", line_range(F.col("text"), F.col("s"), F.col("e")).alias("source"))


def class_prefix(text: str, first_method: int | None, methods: int) -> str:
    """Lines before the first method (else 20 at most) and a note of what follows."""
    lines = text.split("\n")
    head = lines[:first_method] if first_method is not None and first_method > 0 else lines[:PREFIX_LINES]
    return "\n".join(head) + METHODS_NOTE.format(methods)


def pack(text: str, methods: list[str], first_method: int | None, max_tokens: int) -> list[str]:
    """Chunks of a class: whole if it fits, else its prefix with as many methods as fit, greedily; a class
    without methods, or with a prefix beyond the budget, is cut."""
    most = max_tokens * CHARS_PER_TOKEN
    if len(text) <= most:
        return [text]
    prefix = class_prefix(text, first_method, len(methods))
    room = most - len(prefix) - PREFIX_MARGIN
    if not methods or room <= 0:
        return [text[:most] + MARKER]
    chunks, held, size = [], [], 0
    for m in methods:
        if held and size + len(m) > room:
            chunks.append(prefix + "\n".join(held))
            held, size = [], 0
        held.append(m)
        size += len(m)
    return chunks + [prefix + "\n".join(held)]


def chunks(rows: DataFrame, max_tokens: int) -> DataFrame:
    """rows (node_id, kind, text, methods array, first_method) as (node_id, chunk_index, total_chunks, content).
    Greedy packing is a fold with resets, so classes beyond the budget go through Python, batch by batch."""

    def go(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.kind in ("Class", "Interface", "Trait", "Enum"):
                    first = None if pd.isna(r.first_method) else int(r.first_method)
                    got = pack(r.text, list(r.methods) if r.methods is not None else [], first, max_tokens)
                else:
                    got = [r.text if len(r.text) <= max_tokens * 4 else r.text[: max_tokens * 4] + MARKER]
                out += [(r.node_id, i, len(got), c) for i, c in enumerate(got)]
            yield pd.DataFrame(out, columns=["node_id", "chunk_index", "total_chunks", "content"])

    return rows.select("node_id", "kind", "text", "methods", "first_method").mapInPandas(go, "node_id string, chunk_index long, total_chunks long, content string")


def line_packs(docs: DataFrame, most: int) -> DataFrame:
    """Lines of each text, packed greedily in order: (doc_id, chunk, lines, chars). A line beyond the budget
    is a chunk of its own."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("held"), F.array().cast("array<struct<chunk:int,n:int>>").alias("out"))

    def step(a, n):
        new = (a.held > 0) & (a.held + n > most)
        chunk = F.when(new, a.chunk + 1).otherwise(a.chunk)
        return F.struct(chunk.alias("chunk"), F.when(new, n).otherwise(a.held + n).alias("held"), F.concat(a.out, F.array(F.struct(chunk.alias("chunk"), n.alias("n")))).alias("out"))

    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    rows = docs.select("doc_id", F.explode(F.aggregate(sizes, start, step, lambda a: a.out)).alias("x"))
    return rows.groupBy("doc_id", F.col("x.chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("lines"), F.sum("x.n").cast("long").alias("chars"))


def estimates(docs: DataFrame, max_tokens: int) -> DataFrame:
    t = truncated(F.col("text"), max_tokens)
    return docs.select("doc_id", token_estimate(F.col("text")).alias("tokens"), F.length(t).cast("long").alias("kept_chars"), F.md5(t.cast("binary")).alias("kept_md5"))


def enrichable(g: Graph, explained: DataFrame, deny: list[str], kinds: list[str]) -> DataFrame:
    """Nodes of these kinds with a file, not in explained (node_id), and under no denied prefix."""
    n = g.nodes.where(F.col("kind").isin(kinds) & F.col("file").isNotNull())
    for p in deny:
        n = n.where(~F.col("fqn").startswith(p))
    return n.join(explained.select("node_id"), "node_id", "left_anti").select("node_id", "kind", "fqn")


def status(g: Graph, explained: DataFrame, kinds: list[str]) -> DataFrame:
    """Per kind: nodes, and those explained."""
    n = g.of_kind(*kinds).select("node_id", "kind")
    return n.join(explained.select("node_id", F.lit(1).alias("e")), "node_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count("e").alias("explained"))


def type_context(g: Graph) -> DataFrame:
    """Per method: names of the types it hints at, joined."""
    t = g.ends("target", "TYPE_HINT").select(F.col("node_id").alias("target_id"), "fqn")
    return g.of_type("TYPE_HINT").join(t, "target_id").groupBy(F.col("source_id").alias("node_id")).agg(F.array_join(F.sort_array(F.collect_set("fqn")), ",").alias("types"))


def usage_context(g: Graph, limit: int = 5) -> DataFrame:
    """Per class: the first users by id."""
    u = g.of_type("USES").select("target_id", "source_id").distinct()
    k = F.row_number().over(Window.partitionBy("target_id").orderBy("source_id"))
    u = u.withColumn("k", k.cast("long")).where(F.col("k") <= limit)
    t = g.of_kind("Class", "Interface").select(F.col("node_id").alias("target_id"))
    return u.join(t, "target_id", "left_semi").select(F.col("target_id").alias("node_id"), "k", "source_id")


def enrich(rows: DataFrame, explain: Callable[[str, str], str], embed: Callable[[str], list[float]]) -> DataFrame:
    """rows (node_id, fqn, source) with explanation, vector and status; a failing call marks its row only."""

    def go(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    text = explain(r.fqn, r.source)
                    out.append((r.node_id, text, list(map(float, embed(text))), "done", None))
                except Exception as e:  # noqa: BLE001 - any failure of the service is the row's
                    out.append((r.node_id, None, None, "failed", str(e)))
            yield pd.DataFrame(out, columns=["node_id", "explanation", "vector", "status", "error"])

    return rows.select("node_id", "fqn", "source").mapInPandas(go, "node_id string, explanation string, vector array<float>, status string, error string")


def upsert_explanations(nodes: DataFrame, new: DataFrame, model: str) -> DataFrame:
    """nodes with explanation, explain_model and explain_at taken from new (node_id, explanation)."""
    n = new.where("explanation is not null").select("node_id", F.col("explanation").alias("e"))
    both = nodes.join(n, "node_id", "left")
    old = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    values = {"explanation": F.coalesce("e", old("explanation", "string")), "explain_model": F.when(F.col("e").isNotNull(), model).otherwise(old("explain_model", "string")), "explain_at": F.when(F.col("e").isNotNull(), F.current_timestamp()).otherwise(old("explain_at", "timestamp"))}
    return both.select(*[c for c in nodes.columns if c not in values], *[v.alias(c) for c, v in values.items()])
