"""Requests for one symbol: resolve it, extract a bounded sub-graph in Spark, build the tree, serialise it.

Trees follow one JSON contract: lines count from 1, names are camelCase, absent values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.classify import CHAINABLE, LAST_USE, USES_PRIORITY, call_reference, priority
from .graph import Graph
from .operators import definition as D
from .operators import members as M
from .operators import symbols as S
from .operators import values as V
from .operators.trees import flow_entries
from .plans.expand import expand
from .plans.replay import Entry, breadth_first, by_path, depth_first
from .schema import INHERITABLE


class UnknownSymbol(LookupError):
    """No node answers to the name."""


class WrongKind(ValueError):
    """The command doesn't apply to this kind of node."""


def line(n: int | None) -> int | None:
    return None if n is None else n + 1


def slim(d: dict) -> dict:
    """Without absent values and empty lists."""
    return {k: v for k, v in d.items() if v is not None and v != []}


def target(row) -> dict:
    return slim({"id": row.node_id, "kind": row.kind, "name": row.name, "fqn": row.fqn, "file": row.file, "line": line(row.start_line)})


class Api:
    """Commands over one graph; each gives a dict ready for JSON."""

    def __init__(self, graph: Graph):
        self.g = graph

    # --- finding ---

    def resolve(self, query: str) -> dict:
        rows = S.resolve(self.g, query).orderBy("node_ord").collect()
        return {"query": query, "candidates": [target(r) for r in rows]}

    def one(self, query: str):
        rows = S.resolve(self.g, query).orderBy("node_ord").limit(1).collect()
        if not rows:
            raise UnknownSymbol(f"Symbol not found: {query}")
        return rows[0]

    def _nodes(self, ids: set[str]) -> dict:
        """Rows of a request's nodes; their number is bounded by its limit."""
        return {r.node_id: r for r in self.g.nodes.where(F.col("node_id").isin(sorted(ids))).collect()} if ids else {}

    # --- simple walks ---

    def owners(self, query: str) -> dict:
        node = self.one(query)
        rows = S.owners(self.g, node.node_id).join(self.g.nodes.select("node_id", "name"), "node_id").orderBy("distance").collect()
        return {"target": target(node), "chain": [target(r) for r in rows]}

    def _adjacent(self, start: str | list[str], pairs: DataFrame, depth: int, limit: int) -> dict[str, list[tuple[str, dict]]]:
        """Edges out of every node within depth - 1 hops of one or more, in order; of each node those that a walk of ``limit``
        entries can come to. It takes at most limit of a node's edges and passes over those to at most limit + 1
        nodes that it has visited, so it needs the first 2 * limit + 2 neighbours, limit edges to each."""
        starts = [start] if isinstance(start, str) else sorted(set(start))
        root = self.g.nodes.where(F.col("node_id").isin(starts)).select(F.lit("all").alias("root_id"), "node_id")
        near = root.select("node_id")
        if depth > 1:
            near = near.union(expand(root, pairs.select("node_id", "next_id").distinct(), depth - 1, self.g.keep).select("node_id"))
        order = [F.asc_nulls_last("loc_file"), F.asc_nulls_last("loc_line"), "next_id"]
        by_node = Window.partitionBy("node_id")
        again = F.row_number().over(Window.partitionBy("node_id", "next_id").orderBy(*order))
        k = F.row_number().over(by_node.orderBy(*order))
        rows = pairs.join(near.distinct(), "node_id", "left_semi").withColumn("again", again).where(F.col("again") <= limit)
        rows = rows.withColumn("others", F.sum((F.col("again") == 1).cast("int")).over(by_node.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.where(F.col("others") <= 2 * limit + 2).withColumn("k", k).drop("again", "others").orderBy("node_id", "k").collect()
        out: dict[str, list[tuple[str, dict]]] = {}
        for r in rows:
            out.setdefault(r.node_id, []).append((r.next_id, r.asDict()))
        return out

    def _pairs(self, types: list[str], up: bool) -> DataFrame:
        a, b = ("source_id", "target_id") if up else ("target_id", "source_id")
        return self.g.of_type(*types).select(F.col(a).alias("node_id"), F.col(b).alias("next_id"), "type", "loc_file", "loc_line")

    def _tree(self, entries: list[Entry], show) -> list[dict]:
        ids: set[str] = set()
        calls: set[str] = set()

        def gather(es):
            for e in es:
                ids.add(e.node_id)
                if e.edge.get("call_id"):
                    calls.add(e.edge["call_id"])
                gather(e.children)

        gather(entries)
        nodes, given = self._nodes(ids), self._arguments(calls)
        make = lambda e: slim({**show(e, nodes.get(e.node_id)), "arguments": given.get(e.edge.get("call_id")), "children": [make(c) for c in e.children]})
        return [make(e) for e in entries]

    def _arguments(self, calls: set[str]) -> dict[str, list[dict]]:
        """What each of a request's calls is given, by position, and which call each argument comes from."""
        if not calls:
            return {}
        g = self.g
        a = g.args.where(F.col("call_id").isin(sorted(calls)))
        kind = g.nodes.select(F.col("node_id").alias("value_type_id"), F.col("fqn").alias("type_fqn"))
        made = g.calls.select(F.col("call_id").alias("source_call_id"), F.col("callee_fqn").alias("source_fqn"), F.col("on_expr").alias("source_on"))
        rows = a.join(kind, "value_type_id", "left").join(made, "source_call_id", "left").orderBy("call_id", "position", "value_id").collect()
        out: dict[str, list[dict]] = {}
        for r in rows:
            source = slim({"fqn": r.source_fqn, "on": r.source_on})
            shown = {"position": r.position, "parameter": r.parameter, "expression": r.expression or None, "value": r.value_fqn, "valueKind": r.value_kind, "type": r.type_fqn, "source": source or None}
            out.setdefault(r.call_id, []).append(slim(shown))
        return out

    def _walk_uses(self, query: str, depth: int, limit: int, up: bool) -> dict:
        node = self.one(query)
        pairs = self._pairs(["USES"], up)
        key, other = ("target_id", "source_id") if not up else ("source_id", "target_id")
        first = (S.deps_members if up else S.usages_members)(self.g, node.node_id, limit) if node.kind in S.CONTAINERS else None
        rows = first.orderBy("place").collect() if first is not None else []
        if rows:
            edges = self._adjacent([r[other] for r in rows], pairs, depth - 1, limit) if depth > 1 else {}
            edges[node.node_id] = [(r[other], {"loc_file": r.file, "loc_line": r.line}) for r in rows]
        else:
            edges = self._adjacent(node.node_id, pairs, depth, limit)
        found = depth_first(node.node_id, lambda n: edges.get(n, []), depth, limit)

        def show(e: Entry, n) -> dict:
            at = e.edge.get("loc_line")
            if at is None and n is not None and not up:
                at = n.start_line
            return {"depth": e.depth, "id": e.node_id, "kind": n and n.kind, "fqn": n.fqn if n else e.node_id, "file": e.edge.get("loc_file") or (n and n.file), "line": line(at)}

        return {"target": target(node), "maxDepth": depth, "tree": self._tree(found, show)}

    def usages(self, query: str, depth: int = 1, limit: int = 100) -> dict:
        return self._walk_uses(query, depth, limit, False)

    def deps(self, query: str, depth: int = 1, limit: int = 100) -> dict:
        return self._walk_uses(query, depth, limit, True)

    def _walk_levels(self, query: str, types: list[str], kinds: list[str], up: bool, depth: int, limit: int) -> dict:
        node = self.one(query)
        if node.kind not in kinds:
            raise WrongKind(f"{node.fqn} is a {node.kind}; this works for {', '.join(kinds)}")
        edges = self._adjacent(node.node_id, self._pairs(types, up), depth, limit)
        found = breadth_first(node.node_id, lambda n: edges.get(n, []), depth, limit)
        show = lambda e, n: {"depth": e.depth, "id": e.node_id, "kind": n and n.kind, "fqn": n.fqn if n else e.node_id, "file": n and n.file, "line": line(n and n.start_line)}
        return {"root": target(node), "direction": "up" if up else "down", "maxDepth": depth, "tree": self._tree(found, show)}

    def inherit(self, query: str, direction: str = "up", depth: int = 5, limit: int = 100) -> dict:
        return self._walk_levels(query, ["EXTENDS", "IMPLEMENTS"], INHERITABLE, direction == "up", depth, limit)

    def overrides(self, query: str, direction: str = "up", depth: int = 5, limit: int = 100) -> dict:
        return self._walk_levels(query, ["OVERRIDES"], ["Method"], direction == "up", depth, limit)

    # --- context ---

    def definition(self, node) -> dict:
        g, i = self.g, node.node_id
        one = lambda df, key="node_id": (df.where(F.col(key) == i).collect() or [None])[0]
        parent = one(D.parents(g))
        up = self._nodes({parent.parent_id}).get(parent.parent_id) if parent and parent.parent_id else None
        sup = one(D.supertypes(g), "source_id")
        kinds = D.types(g).where(F.col("source_id") == i).collect()
        kids = D.children(g).where(F.col("source_id") == i).orderBy("child_kind").collect()
        flags = one(D.method_flags(g)) if node.kind == "Method" else None
        return slim({
            **target(node), "valueKind": getattr(node, "value_kind", None),
            "declaredIn": up and slim({"fqn": up.fqn, "kind": up.kind, "file": up.file, "line": line(up.start_line)}),
            "extends": sup and sup.extends or None, "implements": sup.implements.split("|") if sup and sup.implements else None,
            "types": {k.type: k.fqn for k in kinds} or None, "members": {k.child_kind: k.n for k in kids} or None,
            "overrides": True if flags and flags.is_override else None, **self._details(node),
        })

    def _details(self, node) -> dict:
        """What a definition tells by kind: arguments and return type, properties and methods in order, declared type."""
        g = self.g
        rows = lambda df, key: df.where(F.col(key) == node.node_id).collect()
        typed = lambda fqn, name: slim({"fqn": fqn, "name": name}) or None
        tell = lambda r, *names: slim({n: r[n] or None for n in names})
        if node.kind in ("Method", "Function"):
            found = rows(M.method_definitions(g), "node_id")
            parts = [a.partition(":") for r in found if r.arguments for a in r.arguments.split(",")]
            return {"arguments": [slim({"name": n, "type": t or None}) for n, _, t in parts], "returnType": found and typed(found[0].return_fqn, found[0].return_name) or None}
        if node.kind in ("Class", "Trait", "Enum"):
            properties = sorted(rows(M.class_properties(g), "class_id"), key=lambda r: r.place)
            methods = sorted(rows(M.class_methods(g), "class_id"), key=lambda r: r.place)
            return {
                "properties": [slim({"name": r.name, "type": r.type_name, **tell(r, "visibility", "readonly", "static", "promoted")}) for r in properties],
                "methods": [slim({"name": r.name, "signature": r.signature, "tags": r.tags.split(",") if r.tags else None}) for r in methods],
                "constructorDeps": [slim({"name": r.name, "type": r.type_name}) for r in properties if r.promoted],
            }
        if node.kind == "Interface":
            found = rows(M.interface_definitions(g), "interface_id")
            return {"methods": [{"name": m} for r in found if r.methods for m in r.methods.split(",")], **({"extends": found[0].extends} if found and found[0].extends else {})}
        if node.kind in ("Property", "Argument"):
            found = rows((M.property_definitions if node.kind == "Property" else M.argument_definitions)(g), "node_id")
            flags = ("visibility", "readonly", "static", "promoted") if node.kind == "Property" else ()
            return {"type": typed(found[0].type_fqn, found[0].type_name), **tell(found[0], *flags)} if found else {}
        if node.kind == "Value":
            found = rows(M.value_definitions(g), "node_id")
            return {"type": typed(found[0].type_fqn, found[0].type_name), "source": typed(found[0].source_fqn, found[0].source_name)} if found else {}
        return {}

    def context(self, query: str, depth: int = 1, limit: int = 100, impl: bool = False, direct: bool = False, imports: bool = False) -> dict:
        """Definition, USED BY and USES of a symbol, each by kind. A constructor answers for its class.
        direct: only references to the symbol itself, none to its members; imports: files count as users."""
        node = self.one(query)
        if node.kind == "Method" and node.name == "__construct":
            up = self.g.nearest_class.where(F.col("node_id") == node.node_id).collect()
            node = self._nodes({up[0].owner_id}).get(up[0].owner_id, node) if up else node
        return {"target": target(node), "maxDepth": depth, "definition": self.definition(node), "usedBy": self.used_by(node, depth, limit, direct, imports), "uses": self.uses(node, depth, limit, impl)}

    def _show_reference(self, e: Entry, n) -> dict:
        d = e.edge
        return {"depth": e.depth, "id": e.node_id, "kind": n and n.kind, "fqn": n.fqn if n else e.node_id, "file": d.get("file"), "line": line(d.get("line")), "refType": d.get("ref_type"), "on": d.get("on_expr"), "onKind": d.get("on_kind"), "callee": d.get("callee"), "accessCount": d.get("accesses"), "methodCount": d.get("methods"), "sites": d.get("sites"), "variable": d.get("local_id"), "crossedFrom": d.get("crossed_from")}

    def _refs_in(self, ids: list[str], imports: bool = False, limit: int = 100, only: str | None = None, outside: bool = False) -> list:
        """References to these nodes with the call behind each, ordered by priority, file and line: of each node those
        that a walk of ``limit`` entries can come to, which are the first from each of 2 * limit + 2 sources. outside:
        none from inside the node; only: of one type."""
        g = self.g
        r = g.refs.where(F.col("target_id").isin(ids))
        r = r if imports else r.where("source_kind <> 'File'")
        c = g.calls.where(F.col("callee_id").isin(ids)).groupBy(F.col("scope_id").alias("source_id"), F.col("callee_id").alias("target_id"))
        c = c.agg(F.min_by(F.struct("call_id", "on_expr", "on_kind", call_reference(F.col("call_kind"), F.col("callee_kind")).alias("call_ref")), "call_id").alias("c"))
        r = r.join(c, ["source_id", "target_id"], "left").withColumn("ref_type", F.coalesce("c.call_ref", "ref_type"))
        r = r.select("target_id", "source_id", "ref_type", F.coalesce("loc_file", "source_file").alias("file"), F.coalesce("loc_line", "source_line").alias("line"), "c.call_id", "c.on_expr", "c.on_kind", priority(F.col("ref_type")).alias("p"))
        if only:
            r = r.where(F.col("ref_type") == only)
        if outside:
            r = r.join(g.anc.select(F.col("node_id").alias("source_id"), F.col("ancestor_id").alias("target_id")), ["source_id", "target_id"], "left_anti")
        order = ["p", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "source_id", "ref_type", F.coalesce("on_expr", F.lit(""))]
        r = r.withColumn("k", F.row_number().over(Window.partitionBy("target_id", "source_id").orderBy(*order))).where("k = 1")
        r = r.withColumn("k", F.row_number().over(Window.partitionBy("target_id").orderBy(*order))).where(F.col("k") <= 2 * limit + 2)
        return r.drop("k").orderBy(*order).collect()

    def _class_entries(self, node, depth: int, limit: int, imports: bool) -> list[Entry]:
        """USED BY of a class by kinds of reference, in this order: subtypes, instantiations, properties of its
        type, calls of its methods, accesses of its properties, other type references. Calls from a class that
        holds the target in a property stand below that property."""
        from .operators import context as C

        g, i = self.g, node.node_id
        order = lambda rows: sorted(rows, key=lambda e: (e.edge.get("file") or "", e.edge.get("line") or 0, e.node_id))
        at = g.calls.select("call_id", "call_file", "call_line")
        subtypes = [Entry(r.source_id, 1, {"ref_type": r.ref_type, "file": r.file, "line": r.line}) for r in C.class_children(g).where(F.col("target_id") == i).orderBy("file", "line", "source_id").limit(limit).collect()]
        made = [Entry(r.scope_id, 1, {"ref_type": "instantiation", "file": r.call_file, "line": r.call_line}) for r in C.constructor_calls(g).where(F.col("class_id") == i).join(at, "call_id").orderBy("call_id").limit(limit).collect() if r.scope_id]
        table = C.interface_injections(g).where(F.col("interface_id") == i) if node.kind == "Interface" else C.typed_properties(g).where(F.col("target_id") == i)
        rows = table.join(g.nodes.select(F.col("node_id").alias("property_id"), "file", "start_line"), "property_id").collect()
        if node.kind == "Interface" and any(r.via == "self" for r in rows):
            rows = [r for r in rows if r.via == "self"]  # direct injection points, if there are any
        props = order({r.property_id: Entry(r.property_id, 1, {"ref_type": "property_type", "file": r.file, "line": r.start_line}) for r in rows}.values())[:limit]
        holders = {r.property_id: r.class_id for r in C._contains(g, "class_id", "property_id").where(F.col("property_id").isin([e.node_id for e in props])).collect()} if props else {}
        of_class = g.nearest_class.select(F.col("node_id").alias("call_id"), F.col("owner_id").alias("by_class"))
        calls = C.external_calls(g).where(F.col("class_id") == i).join(of_class, "call_id", "left").join(at, "call_id").orderBy("call_id").collect()
        names = {r.node_id: r.name for r in g.nodes.where(F.col("node_id").isin(sorted({c.callee_id for c in calls}))).select("node_id", "name").collect()} if calls else {}
        free, below = {}, {}
        for c in calls:
            e = {"ref_type": "method_call", "file": c.call_file, "line": c.call_line, "on_expr": c.on_expr, "on_kind": c.on_kind, "callee": f"{names[c.callee_id]}()"}
            if c.by_class in holders.values():
                below.setdefault(c.by_class, {}).setdefault(c.callee_id, []).append((c.scope_id, e))
            elif c.scope_id not in free:
                free[c.scope_id] = Entry(c.scope_id, 1, e)
        for e in props if depth > 1 else []:
            for callee, sites in sorted(below.get(holders.get(e.node_id), {}).items()):
                one = {**sites[0][1], "line": sites[0][1]["line"] if len(sites) == 1 else None}
                if len(sites) > 1:
                    one["sites"] = [{"method": m, "line": x["line"]} for m, x in sites]
                e.children.append(Entry(callee, 2, one))
        accesses = C.external_accesses(g).where(F.col("class_id") == i).groupBy("callee_id").agg(F.sum("accesses").alias("accesses"), F.countDistinct("scope_id").alias("methods"), F.min("first_line").alias("line")).orderBy("callee_id").limit(limit).collect()
        groups = [Entry(r.callee_id, 1, {"ref_type": "property_access", "line": r.line, "accesses": r.accesses, "methods": r.methods}) for r in accesses]
        seen = {e.node_id for e in made}
        hints = [Entry(r.entry_id, 1, {"ref_type": r.ref_type}) for r in C.handler_param_return(g).where(F.col("target_id") == i).orderBy("entry_id").limit(limit).collect() if r.entry_id not in seen]
        files = [Entry(r.source_id, 1, r.asDict()) for r in self._refs_in([i], True, limit, "type_hint")] if imports else []
        known = {e.node_id for e in hints}
        return [*subtypes, *made, *props, *order(free.values()), *groups, *hints, *(e for e in files if e.node_id not in known)][:limit]

    def used_by(self, node, depth: int, limit: int, direct: bool = False, imports: bool = False) -> list[dict]:
        g = self.g
        if node.kind == "Value":
            return self._value_flow(node.node_id, depth, limit)
        if node.kind == "Property":
            sites = M.property_breakdown(g).where(F.col("property_id") == node.node_id).orderBy(F.asc_nulls_last("line"), "method_id", "on_expr").limit(limit).collect()
            walk = [Entry(r.method_id, 1, {"ref_type": "property_access", "line": r.line, "on_expr": r.on_expr, "on_kind": r.on_kind, "sites": r.accesses}) for r in sites]
            self._expand_callers(walk, {node.node_id, *(e.node_id for e in walk)}, depth, limit, len(walk))
            return self._tree(walk, self._show_reference)
        if node.kind in ("Class", "Interface") and not direct:
            return self._tree(self._with_callers(self._class_entries(node, depth, limit, imports), node.node_id, depth, limit), self._show_reference)
        rows = [(r.source_id, r.asDict()) for r in self._refs_in([node.node_id], imports, limit, outside=node.kind in INHERITABLE)]
        walk = depth_first(node.node_id, lambda n: rows, 1, limit)
        visited = {node.node_id, *(e.node_id for e in walk)}
        self._expand_callers(walk, visited, depth, limit, len(walk))
        return self._tree(walk, self._show_reference)

    def _with_callers(self, entries: list[Entry], root: str, depth: int, limit: int) -> list[Entry]:
        """Below each entry that implies callers, these; every entry has visited nodes of its own."""
        for e in entries:
            if depth > 1 and e.edge.get("ref_type") in ("method_call", "instantiation") and not e.children:
                self._expand_callers([e], {root, e.node_id}, depth, limit, 0)
        return entries

    def _expand_callers(self, level: list[Entry], visited: set[str], depth: int, limit: int, count: int) -> None:
        """Callers of chainable sources, level by level; each level's references are fetched at once."""
        level = [e for e in level if e.edge.get("ref_type") in CHAINABLE]
        for d in range(2, depth + 1):
            rows: dict[str, list] = {}
            for r in self._refs_in([e.node_id for e in level], limit=limit) if level else []:
                rows.setdefault(r.target_id, []).append(r)
            found = []
            for e in level:
                for r in rows.get(e.node_id, []):
                    if count >= limit:
                        break
                    if r.source_id in visited:
                        continue
                    visited.add(r.source_id)
                    count += 1
                    child = Entry(r.source_id, d, r.asDict())
                    e.children.append(child)
                    if r.ref_type in CHAINABLE:
                        found.append(child)
            level = found

    def uses(self, node, depth: int, limit: int, impl: bool = False) -> list[dict]:
        from .operators import context as C

        g = self.g
        if node.kind == "Value":
            return self._value_origin(node.node_id, depth, limit)
        if node.kind in ("Class", "Interface"):
            table = C.class_uses(g)
            if node.kind == "Interface":  # a contract uses what its signatures name, and what it extends
                own = g.nodes.where("kind = 'Interface'").select(F.col("node_id").alias("class_id"))
                named = M.interface_uses(g).select(F.col("interface_id").alias("class_id"), "used_id", "ref_type").withColumn("priority", priority(F.col("ref_type"), USES_PRIORITY, LAST_USE))
                table = table.where("ref_type = 'extends'").unionByName(table.where("ref_type <> 'extends'").join(own, "class_id", "left_anti")).select("class_id", "used_id", "ref_type", "priority").unionByName(named)
            fetch = lambda ids: [(r.class_id, r.used_id, {"ref_type": r.ref_type}) for r in table.where(F.col("class_id").isin(ids)).orderBy("priority", "used_id").collect()]
        elif node.kind in ("Method", "Function"):
            table = flow_entries(g)
            fetch = lambda ids: [(r.scope_id, r.callee_id or r.call_id, {"ref_type": r.ref_type, "call_id": r.call_id, "local_id": r.local_id, "orphan": r.orphan, "file": r.call_file, "line": r.call_line}) for r in table.where(F.col("scope_id").isin(ids)).where(F.col("k") <= limit + depth).orderBy("scope_id", "k").collect()]
        elif node.kind == "Property":
            typed = C.typed_properties(g).select("property_id", "target_id", F.lit("property_type").alias("ref_type"), F.lit(None).cast("string").alias("call_id"))
            given = M.property_inputs(g).select("property_id", F.coalesce("value_id", "call_id").alias("target_id"), F.lit("argument").alias("ref_type"), "call_id")
            table = typed.union(given)
            fetch = lambda ids: [(r.property_id, r.target_id, {"ref_type": r.ref_type, "call_id": r.call_id}) for r in table.where(F.col("property_id").isin(ids)).orderBy(F.desc("ref_type"), "target_id", "call_id").limit(limit).collect()]
        else:
            return []
        known: dict[str, list[tuple[str, dict]]] = {}
        level = [(node.node_id, frozenset([node.node_id]))]
        for _ in range(depth):
            ids = sorted({n for n, _ in level} - known.keys())
            known |= {n: [] for n in ids}
            for a, b, e in fetch(ids) if ids else []:
                known[a].append((b, e))
            # the walk enters a level from its first place on, and limit places of it at most
            level = [(b, path | {b}) for n, path in level for b, _ in known[n] if b not in path][:limit]
        found = self._shown(by_path(node.node_id, lambda n: known.get(n, []), depth, limit))
        out = self._tree(found, self._show_reference)
        if impl and node.kind == "Interface":
            rows = C.implementors(g).where(F.col("interface_id") == node.node_id).orderBy("distance", "class_id").limit(limit).collect()
            names = self._nodes({r.class_id for r in rows})
            out += [slim({"depth": 1, "id": r.class_id, "kind": names[r.class_id].kind, "fqn": names[r.class_id].fqn, "refType": "implements"}) for r in rows]
        return out

    def _shown(self, entries: list[Entry]) -> list[Entry]:
        """Without accesses that an argument beside them spells out."""
        for e in entries:
            e.children = self._shown(e.children)
        return [e for e in entries if not e.edge.get("orphan")]

    def _calls_of(self, rows: list, more) -> list[dict]:
        """Entries of calls (call_id, level), each shown as what it calls."""
        calls = {r.call_id: r for r in self.g.calls.where(F.col("call_id").isin(sorted(r.call_id for r in rows))).withColumn("ref_type", call_reference(F.col("call_kind"), F.col("callee_kind"))).collect()} if rows else {}
        entries = []
        for r in rows:
            c = calls[r.call_id]
            edge = {"ref_type": c.ref_type, "file": c.call_file, "line": c.call_line, "on_expr": c.on_expr, "on_kind": c.on_kind, "call_id": r.call_id, **more(r)}
            entries.append(Entry(c.callee_id or r.call_id, r.level, edge))
        return self._tree(entries, self._show_reference)

    def _value_flow(self, start: str, depth: int, limit: int) -> list[dict]:
        """The calls that consume a value's content, within methods and across them, each at its least level."""
        roots = self.g.nodes.where(F.col("node_id") == start).select(F.col("node_id").alias("value_id"))
        rows = V.value_flow(self.g, roots, depth).orderBy("level", "call_id").limit(limit).collect()
        return self._calls_of(rows, lambda r: {"crossed_from": r.crossed_from})

    def _value_origin(self, start: str, depth: int, limit: int) -> list[dict]:
        """The calls that a value's content comes from, each at its least level."""
        roots = self.g.nodes.where(F.col("node_id") == start).select("node_id")
        rows = V.value_origin(self.g, depth, roots).orderBy("level", "call_id").limit(limit).collect()
        return self._calls_of(rows, lambda r: {})

