"""All commands by name, as the command line and the tool server offer them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Api, UnknownSymbol
from .operators import flows as W
from .operators import texts as X
from .operators.search import search_all
from .store import Project

SERVER_LIMIT = 50


class Service:
    """Commands over projects under one folder. ``embed`` and ``explain`` stand for outside services; without
    them, the commands that need one say so."""

    def __init__(self, spark: SparkSession, root: str, sources: str | None = None, embed: Callable[[str], list[float]] | None = None, explain: Callable[[str, str], str] | None = None, complete: Callable[[str, int, float], str] | None = None):
        self.complete = complete
        self.spark, self.root, self.sources, self.embed, self.explain = spark, root, sources, embed, explain
        self._projects: dict[str, Project] = {}
        self.commands: dict[str, Callable[..., dict]] = {
            n: getattr(self, n) for n in ("resolve", "owners", "usages", "deps", "inherit", "overrides", "context", "flows", "messages", "events", "http_clients", "source", "chunks", "search", "enrich", "enrich_project", "enrich_status", "verify", "counts", "import_symbols", "import_flows", "projects", "reset", "vacuum")
        }

    def project(self, name: str = "default") -> Project:
        if name not in self._projects:
            self._projects[name] = Project(self.spark, self.root, name)
        return self._projects[name]

    def api(self, project: str) -> Api:
        return Api(self.project(project).graph)

    def projects(self) -> dict:
        return {"projects": sorted(self._projects)}

    def resolve(self, symbol: str, project: str = "default") -> dict:
        return self.api(project).resolve(symbol)

    def owners(self, symbol: str, project: str = "default") -> dict:
        return self.api(project).owners(symbol)

    def usages(self, symbol: str, depth: int = 1, limit: int = 100, project: str = "default") -> dict:
        return self.api(project).usages(symbol, depth, limit)

    def deps(self, symbol: str, depth: int = 1, limit: int = 100, project: str = "default") -> dict:
        return self.api(project).deps(symbol, depth, limit)

    def inherit(self, symbol: str, direction: str = "up", depth: int = 5, limit: int = 100, project: str = "default") -> dict:
        return self.api(project).inherit(symbol, direction, depth, limit)

    def overrides(self, symbol: str, direction: str = "up", depth: int = 5, limit: int = 100, project: str = "default") -> dict:
        return self.api(project).overrides(symbol, direction, depth, limit)

    def context(self, symbol: str, depth: int = 1, limit: int = 100, impl: bool = False, direct: bool = False, imports: bool = False, project: str = "default") -> dict:
        return self.api(project).context(symbol, depth, limit, impl, direct, imports)

    # --- flows: a list, candidates, or the details of one ---

    def _entities(self, name: str, key: str, others: list[str], query: str | None, project: str, types: list[str] | None = None) -> dict:
        t = self.project(project).table(name)
        if t is None:
            return {"rows": []}
        if types:
            t = t.where(F.col("type").isin(types))
        if query is None:
            return {"rows": [r.asDict() for r in t.orderBy(*(["type"] if "type" in t.columns else []), key).collect()]}
        rows = W.find(t, key, others, query).collect()
        if len(rows) != 1:
            return {"candidates": [r.asDict() for r in rows]}
        e = self.project(project).table("flow_edges").where((F.col("from_id") == rows[0][key]) | (F.col("to_id") == rows[0][key])).orderBy("type", "from_id", "to_id").collect()
        return {"detail": rows[0].asDict(), "rows": [{k: v for k, v in r.asDict().items() if v is not None} for r in e]}

    def flows(self, query: str | None = None, types: list[str] | None = None, project: str = "default") -> dict:
        return self._entities("flows", "flow_id", ["entry_fqn", "name"], query, project, types)

    def messages(self, query: str | None = None, project: str = "default") -> dict:
        return self._entities("messages", "id", ["fqn"], query, project)

    def events(self, query: str | None = None, project: str = "default") -> dict:
        return self._entities("events", "id", ["fqn"], query, project)

    def http_clients(self, query: str | None = None, project: str = "default") -> dict:
        return self._entities("http_clients", "id", ["service_id", "class_fqn", "base_uri"], query, project)

    # --- text and vectors ---

    def _text(self, node, project: str):
        if not self.sources:
            raise UnknownSymbol("no folder of sources is configured")
        g = self.project(project).graph
        files = self.spark.read.text(f"{self.sources.rstrip('/')}/{node.file}", wholetext=True).select(F.lit(node.file).alias("file"), F.col("value").alias("text"))
        rows = X.source(files, g.nodes.where(F.col("node_id") == node.node_id)).collect()
        return rows[0].source if rows else None

    def source(self, symbol: str, project: str = "default") -> dict:
        node = self.api(project).one(symbol)
        return {"target": {"id": node.node_id, "fqn": node.fqn, "kind": node.kind}, "source": self._text(node, project) or ""}

    def chunks(self, symbol: str, max_tokens: int = 8000, project: str = "default") -> dict:
        node = self.api(project).one(symbol)
        g = self.project(project).graph
        text = self._text(node, project) or ""
        kids = g.of_type("CONTAINS").where(F.col("source_id") == node.node_id).select(F.col("target_id").alias("node_id"))
        methods = g.nodes.join(kids, "node_id").where("kind = 'Method'").orderBy("start_line").collect()
        base = node.enclosing_start_line or node.start_line or 0
        starts = [m.enclosing_start_line or m.start_line for m in methods]
        first = min((s - base for s in starts if s is not None), default=None)
        texts = [self._text(m, project) or "" for m in methods]
        row = self.spark.createDataFrame([(node.node_id, node.kind, text, texts, first)], "node_id string, kind string, text string, methods array<string>, first_method long")
        return {"chunks": [r.asDict() for r in X.chunks(row, max_tokens).orderBy("chunk_index").collect()]}

    def search(self, query: str, limit: int = 10, project: str = "default") -> dict:
        v = self.project(project).table("embeddings")
        if self.embed is None:
            raise UnknownSymbol("no embedding service is configured")
        return {"results": [] if v is None else [r.asDict() for r in search_all(v, self.embed(query), limit).collect()]}

    def enrich(self, symbol: str, project: str = "default") -> dict:
        if self.explain is None or self.embed is None:
            raise UnknownSymbol("no explaining or embedding service is configured")
        node = self.api(project).one(symbol)
        row = self.spark.createDataFrame([(node.node_id, node.fqn, self._text(node, project) or "")], "node_id string, fqn string, source string")
        return {"results": [r.asDict() for r in X.enrich(row, self.explain, self.embed).collect()]}

    def enrich_project(self, force: bool = False, project: str = "default") -> dict:
        """Explains and embeds all methods and classes whose source is at hand, but those explained before (unless
        forced). Answers are stored first and then read, so no service is asked twice; nodes get their explanations,
        and the collection embeddings the new vectors."""
        if self.complete is None or self.embed is None:
            raise UnknownSymbol("no completing or embedding service is configured")
        if not self.sources:
            raise UnknownSymbol("no folder of sources is configured")
        return self.project(project).enrich(self.sources, self.complete, self.embed, force)

    def enrich_status(self, project: str = "default") -> dict:
        g = self.project(project).graph
        done = g.nodes.where(F.lit(False)).select("node_id") if "explanation" not in g.nodes.columns else g.nodes.where("explanation is not null").select("node_id")
        return {"rows": [r.asDict() for r in X.status(g, done, ["Class", "Method"]).orderBy("kind").collect()]}

    # --- import ---

    def import_symbols(self, path: str, validate: bool = True, project: str = "default") -> dict:
        return self.project(project).import_symbols(path, validate)

    def import_flows(self, path: str, project: str = "default") -> dict:
        return self.project(project).import_flows(path)

    def verify(self, project: str = "default") -> dict:
        return self.project(project).verify()

    def counts(self, project: str = "default") -> dict:
        return self.project(project).counts()

    def reset(self, project: str = "default") -> dict:
        self.project(project).reset()
        return {"reset": project}

    def vacuum(self, project: str = "default") -> dict:
        """Deletes what the current version doesn't name; for when no one reads an older one."""
        return {"deleted": self.project(project).vacuum()}
