import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import projected
from weftgraph.operators import trees as T
from weftgraph.plans.replay import depth_first

from .test_values import Program


def rows_of(entries, root):
    out = []

    def put(es, parent):
        for e in es:
            out.append((len(out) + 1, e.depth, e.node_id, parent))
            put(e.children, e.node_id)

    put(entries, root)
    return out


def by_root(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.root_id].append((r.place, r.depth, r.node_id, r.parent_id))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("depth,limit", [(1, 5), (2, 4), (3, 7), (3, 1000), (4, 30)])
def test_random_graphs_equal_the_walk(spark, depth, limit):
    rnd = random.Random(depth * 100 + limit)
    ids = [f"n{i:02}" for i in range(30)]
    rows = [(rnd.choice(ids), rnd.choice(ids), rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None])) for _ in range(160)]
    rows += [("n00", i, "a", 1) for i in ids] + rows[:20]  # a hub, a loop and repeated edges
    df = spark.createDataFrame(rows, "node_id string, next_id string, loc_file string, loc_line long").repartition(3)
    near = T.neighbours(df, limit)
    starts = near.select(F.col("node_id").alias("root_id"), "nexts")
    got = by_root(T.walks(near, starts, depth, limit, lambda d, n: d))
    every = defaultdict(list)
    for a, b, file, at in sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[3] is None, r[3] or 0, r[1])):
        every[a].append((b, {"loc_file": file, "loc_line": at}))
    want = {r: rows_of(depth_first(r, lambda n: every.get(n, []), depth, limit), r) for r in every}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("up", [False, True])
def test_all_classes_equal_the_walk(spark, sf, up):
    g = projected(spark, sf)
    node, other = ("source_id", "target_id") if up else ("target_id", "source_id")
    last = lambda r: (r.loc_file is None, r.loc_file or "", r.loc_line is None, r.loc_line or 0)
    edges = g.of_type("USES").collect()
    every, inside = defaultdict(list), defaultdict(set)
    for r in sorted(edges, key=lambda r: (*last(r), r[other])):
        every[r[node]].append((r[other], {"loc_file": r.loc_file, "loc_line": r.loc_line}))
    for r in g.anc.collect():
        inside[r.ancestor_id].add(r.node_id)
    of = defaultdict(list)
    for r in edges:
        of[r[node]].append(r)
    got = by_root(T.uses_trees(g, up, 3, 40))
    roots = [r.node_id for r in g.nodes.where(F.col("kind").isin(*T.CONTAINERS)).collect()]
    for root in roots:
        first = sorted((e for m in {root, *inside[root]} for e in of[m]), key=lambda r: (*last(r), r.source_id, r.target_id))[:40]
        top = [(r[other], {"loc_file": r.loc_file, "loc_line": r.loc_line}) for r in first]
        want = rows_of(depth_first(root, lambda n: top if n == root else every.get(n, []), 3, 40), root)  # noqa: B023
        assert got.get(root, []) == want, root


def flow_program(n, seed):
    p = Program()
    rnd = random.Random(seed)
    methods = [f"m{i}" for i in range(n)]
    for m in methods:
        p.node(m, "Method", f"App::{m}()")
    p.node("prop", "Property", "App::$prop")
    own = defaultdict(list)
    for i in range(6 * n):
        m, to = rnd.choice(methods), rnd.choice([*methods, "prop"])
        args = [(v, None) for v in rnd.sample(own[m], min(len(own[m]), rnd.choice([0, 0, 1])))]
        out = rnd.random() < 0.5
        p.call(f"c{i:03}", m, to, args=args, result=f"r{i:03}" if out else None, local=f"l{i:03}" if out and rnd.random() < 0.5 else None, kind="access" if to == "prop" else "method")
        own[m] += [f"r{i:03}"] * out
    return p


def flowed(p, root, depth, limit):
    """The walk of one method: a shared count, callees seen on the path."""
    by = lambda kind: [e for e in p.edges if e[0] == kind]
    scope, callee, made = {e[2]: e[1] for e in by("CONTAINS")}, {e[1]: e[2] for e in by("CALLS")}, {e[2]: e[1] for e in by("PRODUCES")}
    local = {e[2]: e[1] for e in by("ASSIGNED_FROM")}
    consumed = {made[e[2]] for e in by("ARGUMENT") + by("RECEIVER") if e[2] in made and made[e[2]] != e[1] and scope[made[e[2]]] == scope[e[1]]}
    out, count = [], 0

    def go(m, level, seen, parent):
        nonlocal count
        here = set()
        for c in sorted(c for c in callee if scope[c] == m and c not in consumed):
            if count >= limit:
                return
            if callee[c] in here or callee[c] in seen:
                continue
            here.add(callee[c])
            count += 1
            result = next((r for r, by_call in made.items() if by_call == c), None)
            out.append((count, level, parent, c, callee[c], local.get(result)))
            if level < depth:
                go(callee[c], level + 1, seen | {callee[c]}, c)

    go(root, 1, {root}, None)
    return out


@pytest.mark.parametrize("limit", [4, 25, 1000])
def test_execution_flow_equals_the_walk(spark, limit):
    p = flow_program(9, limit)
    got = defaultdict(list)
    for r in T.execution_trees(p.graph(spark), 3, limit).collect():
        got[r.root_id].append((r.place, r.depth, r.parent_id, r.call_id, r.callee_id, r.local_id))
    for m in (f"m{i}" for i in range(9)):
        assert sorted(got[m]) == flowed(p, m, 3, limit), m


def test_accesses_that_an_argument_spells_out_are_not_shown(spark):
    p = Program()
    for m in ("run", "use"):
        p.node(m, "Method", f"App::{m}()")
    for name in ("id", "other"):
        p.node(f"p.{name}", "Property", f"App::${name}")
        p.call(f"read.{name}", "run", f"p.{name}", kind="access")
    p.value("v", "local", "run")
    p.call("send", "run", "use")
    p.edges.append(("ARGUMENT", "send", "v", None, None, 0, "f($this->id)", None))
    assert sorted((r.place, r.call_id) for r in T.execution_trees(p.graph(spark)).collect()) == [(2, "read.other"), (3, "send")]
