"""What is asked of language and embedding models about symbols and flows: settings, prompts, and runs that
skip what is done, mark what fails and count both."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, ProjectedGraph
from .texts import type_context, usage_context

# --- settings ---


@dataclass(frozen=True)
class Provider:
    """Where a model answers. dimension is for embeddings only."""

    url: str = ""
    key: str = field(default="", repr=False)
    model: str = ""
    dimension: int | None = None


@dataclass(frozen=True)
class Settings:
    """The two providers are independent: explaining needs the first, searching the second, enriching both."""

    llm: Provider = Provider()
    embedding: Provider = Provider(dimension=4096)
    root: str = ""
    project: str = "default"
    chunk_tokens: int = 8000

    @classmethod
    def read(cls, values: Mapping[str, str]) -> Settings:
        """From names such as LLM_API_KEY or EMBEDDING_MODEL; what is absent has its default."""
        provider = lambda p, **more: Provider(values.get(f"{p}_API_URL", ""), values.get(f"{p}_API_KEY", ""), values.get(f"{p}_MODEL", ""), **more)
        return cls(
            provider("LLM"), provider("EMBEDDING", dimension=int(values.get("EMBEDDING_DIMENSION", 4096))),
            values.get("PROJECT_ROOT", ""), values.get("PROJECT_NAME", "default"), int(values.get("MAX_TOKENS_PER_CHUNK", 8000)),
        )

    def lacking(self, llm: bool = True, embedding: bool = True) -> list[str]:
        """What an operation that uses these providers still needs."""
        wanted = [("LLM_API_KEY", self.llm.key, llm), ("EMBEDDING_API_KEY", self.embedding.key, embedding), ("PROJECT_ROOT", self.root, True)]
        return [f"{name} is required" for name, value, needed in wanted if needed and not value]


@dataclass(frozen=True)
class Task:
    max_tokens: int
    temperature: float
    instruction: str


TASKS = {
    "Method": Task(1024, 0.3, "Explain what this method does, what it reads and writes, and what it calls."),
    "Class": Task(1024, 0.3, "Explain what this class is for, what it depends on and how others use it."),
    "Flow": Task(512, 0.3, "Explain in a few sentences what this flow does, from its trigger to its effects."),
}
REF_CHARS, REF_NODES, REF_DEPTH = 2000, 12, 3


def vector_of(response: Mapping) -> tuple[list[float], dict | None]:
    """An embedding and its token counts, which some services leave out or send as null."""
    return list(map(float, response["data"][0]["embedding"])), dict(response["usage"]) if response.get("usage") else None


# --- prompts ---


def _part(title: str, value: Column) -> Column:
    """Null, and so left out of the prompt, where there is nothing to tell."""
    return F.when(value != "", F.concat(F.lit(f"{title}: "), value))


def _task(kind: Column, of: Callable[[Task], object]) -> Column:
    out = F.lit(None)
    for name, t in TASKS.items():
        out = F.when(kind == name, F.lit(of(t))).otherwise(out)
    return out


def _asking(kind: Column, *parts: Column) -> list[Column]:
    """Prompt, length of the answer and temperature, as the kind's task has them."""
    text = F.concat_ws("\n\n", _task(kind, lambda t: t.instruction), *parts)
    return [text.alias("prompt"), _task(kind, lambda t: t.max_tokens).alias("max_tokens"), _task(kind, lambda t: t.temperature).alias("temperature")]


def symbol_prompts(g: Graph, sources: DataFrame) -> DataFrame:
    """(id, prompt, max_tokens, temperature) of the methods and classes in sources (node_id, source): with the
    types they name, the classes' first users and, of methods, the class they stand in."""
    name = g.ends("source", "USES").select("node_id", "fqn")
    users = usage_context(g).join(name.select(F.col("node_id").alias("source_id"), "fqn"), "source_id")
    users = users.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "fqn"))), lambda x: x.fqn), ", ").alias("users"))
    up = g.containing("Method", "Class").select(F.col("target_id").alias("node_id"), F.col("source_id").alias("parent_id"))
    up = up.join(g.of_kind("Class", "Interface", "Trait", "Enum").select(F.col("node_id").alias("parent_id"), F.col("fqn").alias("parent")), "parent_id").select("node_id", "parent")
    rows = g.of_kind("Method", "Class").select("node_id", "kind", "fqn").join(sources, "node_id")
    for more in (up, type_context(g), users):
        rows = rows.join(more, "node_id", "left")
    parts = [_part(t, F.col(c)) for t, c in (("Symbol", "fqn"), ("Declared in", "parent"), ("Types", "types"), ("Used by", "users"))]
    return rows.select(F.col("node_id").alias("id"), *_asking(F.col("kind"), *parts, F.concat(F.lit("Source:\n"), "source")))


def _names(df: DataFrame, label: str, kind: str, other: str, name: str) -> DataFrame:
    return df.where(F.col(label) == kind).groupBy("flow_id").agg(F.array_join(F.sort_array(F.collect_set(other)), ", ").alias(name))


def flow_prompts(g: ProjectedGraph, sources: DataFrame) -> DataFrame:
    """(id, prompt, max_tokens, temperature) of flows: their entry, what starts them, what they send, and the
    sources (node_id, source) of the entry and of the symbols that flow_walk gives, nearest first."""
    name = g.of_kind("Method", "Function").select(F.col("node_id").alias("method_node_id"), F.col("fqn").alias("entry"))
    cut = sources.select("node_id", F.substring("source", 1, REF_CHARS).alias("source"), F.substring("source", 1, REF_CHARS * 4).alias("long"))
    near = flow_walk(g).join(cut, "node_id").groupBy("flow_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "source"))), lambda x: x.source), "\n\n").alias("near"))
    own = cut.select(F.col("node_id").alias("method_node_id"), F.col("long").alias("source"))
    rows = g.flows.select("flow_id", "type", "method_node_id").join(name, "method_node_id", "left").join(own, "method_node_id", "left").join(near, "flow_id", "left")
    for df, label, other, names in ((g.emits, "to_label", "to_id", ("sends", "raises")), (g.handled_by, "from_label", "from_id", ("handles", "hears"))):
        for kind, column in zip(("Message", "Event"), names):
            rows = rows.join(_names(df, label, kind, other, column), "flow_id", "left")
    titles = (("Flow", "flow_id"), ("Type", "type"), ("Entry", "entry"), ("Started by messages", "handles"), ("Started by events", "hears"), ("Sends messages", "sends"), ("Raises events", "raises"))
    parts = [_part(t, F.col(c)) for t, c in titles]
    return rows.select(F.col("flow_id").alias("id"), *_asking(F.lit("Flow"), *parts, F.concat(F.lit("Source:\n"), "source"), F.concat(F.lit("Uses:\n"), "near")))


def flow_walk(g: ProjectedGraph, depth: int = REF_DEPTH, most: int = REF_NODES) -> DataFrame:
    """(flow_id, k, node_id): the first ``most`` symbols that a flow's entry uses, directly or through others,
    nearest first, then by id. A level beyond the most is never walked, so each flow's frontier stays below it,
    and of a symbol's own uses the first 2 * most + 1 are enough: most are taken, at most most + 1 passed over."""
    by_source = Window.partitionBy("node_id").orderBy("next_id")
    pairs = g.of_type("USES").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("next_id")).distinct()
    pairs = g.keep(pairs.withColumn("r", F.row_number().over(by_source)).where(F.col("r") <= 2 * most + 1).drop("r"), "first-uses")
    new = g.flows.where("method_node_id is not null").select("flow_id", F.lit(0).cast("long").alias("k"), F.col("method_node_id").alias("node_id"))
    seen = new
    for _ in range(depth):
        so_far = seen.groupBy("flow_id").agg(F.max("k").alias("had")).where(F.col("had") < most)
        grown = new.join(so_far, "flow_id").join(pairs, "node_id").select("flow_id", "had", F.col("next_id").alias("node_id")).distinct()
        grown = grown.join(seen.select("flow_id", "node_id"), ["flow_id", "node_id"], "left_anti")
        k = F.col("had") + F.row_number().over(Window.partitionBy("flow_id").orderBy("node_id"))
        new = g.keep(grown.select("flow_id", k.cast("long").alias("k"), "node_id").where(F.col("k") <= most), "flow-walk")
        seen = seen.union(new)
    return seen.where("k > 0")


def entry_methods(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(flow_id, node_id, found_by) of flows (flow_id, method_node_id, entry_fqn, entry_method): by the stored
    edge, else the method of that name, else the class. Of nodes that share a name the first in the graph."""
    first = nodes.where("kind in ('Method', 'Function', 'Class', 'Interface', 'Trait', 'Enum')").groupBy("fqn").agg(F.min(F.struct("node_ord", "node_id")).alias("f"))
    named = lambda c: first.select(F.col("fqn").alias(f"{c}_fqn"), F.col("f.node_id").alias(c))
    rows = flows.withColumn("method_fqn", F.concat("entry_fqn", F.lit("::"), "entry_method", F.lit("()"))).withColumnRenamed("entry_fqn", "class_fqn")
    rows = rows.join(named("method"), "method_fqn", "left").join(named("class"), "class_fqn", "left")
    by = F.when(F.col("method_node_id").isNotNull(), "edge").when(F.col("method").isNotNull(), "method").when(F.col("class").isNotNull(), "class")
    return rows.select("flow_id", F.coalesce("method_node_id", "method", "class").alias("node_id"), by.alias("found_by"))


# --- runs ---

RESULT = "id string, explanation string, vector array<float>, status string, error string"


def run(prompts: DataFrame, done: DataFrame, explain: Callable[[str, int, float], str], embed: Callable[[str], list[float]], force: bool = False) -> DataFrame:
    """Asks for every prompt but those of ids in done (id), unless forced. One row an id: done, failed with its
    error, or skipped. A call that fails or answers nothing fails its own row only."""
    known = done.select("id").distinct()
    todo = prompts if force else prompts.join(known, "id", "left_anti")

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    text = explain(r.prompt, int(r.max_tokens), float(r.temperature))
                    if not text:
                        raise ValueError("empty explanation")
                    out.append((r.id, text, list(map(float, embed(text))), "done", None))
                except Exception as e:  # noqa: BLE001 - any failure of the service is the row's
                    out.append((r.id, None, None, "failed", str(e)))
            yield pd.DataFrame(out, columns=["id", "explanation", "vector", "status", "error"])

    asked = todo.select("id", "prompt", "max_tokens", "temperature").mapInPandas(go, RESULT)
    if force:
        return asked
    none = lambda kind: F.lit(None).cast(kind)
    skipped = prompts.join(known, "id", "left_semi").select("id", none("string").alias("explanation"), none("array<float>").alias("vector"), F.lit("skipped").alias("status"), none("string").alias("error"))
    return asked.unionByName(skipped)


def totals(results: DataFrame) -> DataFrame:
    """One row: how many of all were done, failed and skipped. results must be stored, or they are asked again."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return results.agg(F.count(F.lit(1)).alias("total"), n("done"), n("failed"), n("skipped"))
