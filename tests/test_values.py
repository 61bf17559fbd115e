import random
from collections import defaultdict

import pytest

from weftgraph.graph import Graph
from weftgraph.operators import values as V
from weftgraph.sources.projection import EDGE_COLUMNS, NODE_COLUMNS


class Program:
    """Nodes and edges of a small program, by hand."""

    def __init__(self):
        self.nodes, self.edges = {}, []

    def node(self, i, kind, fqn=None, call_kind=None, value_kind=None, line=1, name=None):
        self.nodes[i] = (len(self.nodes), i, kind, name or i, fqn or i, "f.php", line, call_kind, value_kind)

    def edge(self, kind, a, b, parameter=None, loc_line=None):
        self.edges.append((kind, a, b, "f.php" if loc_line is not None else None, loc_line, 0 if kind == "ARGUMENT" else None, None, parameter))

    def value(self, i, kind, scope, type_=None, fqn=None):
        self.node(i, "Value", fqn, value_kind=kind)
        self.edge("CONTAINS", scope, i)
        if type_:
            self.edge("TYPE_OF", i, type_)

    def call(self, i, scope, callee, on=None, args=(), result=None, local=None, type_=None, kind="method"):
        """args: (value, parameter)"""
        self.node(i, "Call", call_kind=kind)
        self.edge("CONTAINS", scope, i)
        self.edge("CALLS", i, callee)
        if on:
            self.edge("RECEIVER", i, on)
        for v, p in args:
            self.edge("ARGUMENT", i, v, p)
        if result:
            self.value(result, "result", scope, type_)
            self.edge("PRODUCES", i, result)
        if local:
            self.value(local, "local", scope, type_)
            self.edge("ASSIGNED_FROM", local, result)

    def graph(self, spark):
        nodes = spark.createDataFrame(list(self.nodes.values()), ", ".join(f"{c} {'long' if c in ('node_ord', 'start_line') else 'string'}" for c in NODE_COLUMNS))
        edges = spark.createDataFrame(self.edges, ", ".join(f"{c} {'long' if c in ('loc_line', 'position') else 'string'}" for c in EDGE_COLUMNS))
        return Graph(spark, nodes, edges)


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "value_id string")


def flows(g, spark, *ids, depth=3):
    return {(r.root_id, r.call_id): (r.level, r.crossings, r.crossed_from, r.via) for r in V.value_flow(g, roots(spark, *ids), depth).collect()}


@pytest.fixture(scope="module")
def shop(spark):
    p = Program()
    for m in ("main", "pass_on", "save", "loop"):
        p.node(m, "Method", f"App::{m}()")
    p.node("T", "Class")
    p.node("U", "Class")
    p.node("prop", "Property")
    p.value("x", "parameter", "pass_on", fqn="App::pass_on().$x")
    p.value("s", "parameter", "save", fqn="App::save().$s")
    p.value("n", "parameter", "loop", fqn="App::loop().$n")
    p.value("start", "local", "main")
    # pass_on($x) { return save($x->prop, $x); }
    p.call("read", "pass_on", "prop", on="x", result="read.r", kind="access")
    p.call("keep", "pass_on", "save", args=[("read.r", "App::save().$s"), ("x", None)], result="keep.r", type_="T")
    # save($s) { $s->prop; loop($s); }
    p.call("peek", "save", "prop", on="s", result="peek.r", kind="access")
    p.call("again", "save", "loop", args=[("s", "App::loop().$n")])
    # loop($n) { return loop($n); }
    p.call("round", "loop", "loop", args=[("n", "App::loop().$n")], result="round.r", type_="T")
    # main: $a = pass_on($start) of type T; $b = pass_on($start) of type U; save($a)
    p.call("go", "main", "pass_on", args=[("start", "App::pass_on().$x")], result="go.r", local="a", type_="T")
    p.call("go2", "main", "pass_on", args=[("start", "App::pass_on().$x")], result="go2.r", local="b", type_="U")
    p.call("end", "main", "save", args=[("a", "App::save().$s")])
    p.call("end2", "main", "save", args=[("b", "App::save().$s")])
    return p


def test_flow_across_methods(spark, shop):
    g = shop.graph(spark)
    got = flows(g, spark, "x", depth=3)
    assert got[("x", "keep")] == (1, 0, None, "receiver")  # what was read of it is handed on, beside itself
    assert got[("x", "peek")] == (2, 0, "App::save().$s", "access")
    assert got[("x", "again")] == (2, 0, "App::save().$s", "argument")
    assert got[("x", "end")] == (2, 1, "App::main()", "argument")  # returned, into the local of the same type only
    assert ("x", "end2") not in got
    assert got[("x", "round")] == (3, 0, "App::loop().$n", "argument")
    start = flows(g, spark, "start", depth=2)
    assert start[("start", "go")] == (1, 0, None, "argument") and start[("start", "end")] == (2, 0, None, "argument")
    assert start[("start", "keep")] == (2, 0, "App::pass_on().$x", "receiver")


def test_recursion_ends(spark, shop):
    got = flows(shop.graph(spark), spark, "n", depth=12)
    assert got == {("n", "round"): (1, 0, None, "argument")}


def test_origin_through_parameters_and_receivers(spark, shop):
    got = defaultdict(dict)
    for r in V.value_origin(shop.graph(spark), 5).collect():
        got[r.value_id][r.call_id] = r.level
    assert got["a"] == {"go": 1}  # start comes from nowhere
    assert got["s"] == {"keep": 1, "end": 1, "end2": 1, "go": 2, "go2": 2, "read": 2}
    assert got["n"]["again"] == 1 and got["n"]["round"] == 1 and got["n"]["keep"] == 2
    assert got["keep.r"] == {"keep": 1, "go": 2, "go2": 2}


def walked(p, root, depth):
    """All paths, one by one: {call: (level, crossings, label, via)}, the least of each at the least level."""
    by = lambda kind: [e for e in p.edges if e[0] == kind]
    one = lambda kind, key, val: {e[key]: e[val] for e in sorted(by(kind), reverse=True)}
    result, local, types, callee = one("PRODUCES", 1, 2), one("ASSIGNED_FROM", 2, 1), one("TYPE_OF", 1, 2), one("CALLS", 1, 2)
    scope = {e[2]: e[1] for e in by("CONTAINS")}
    param = {n[4]: n[1] for n in p.nodes.values() if n[8] == "parameter"}
    uses = defaultdict(dict)

    def put(v, c, via):
        uses[v][c] = min(via, uses[v].get(c, 9))

    for e in by("ARGUMENT"):
        put(e[2], e[1], 2)
    for e in by("RECEIVER"):
        made = [x[2] for x in by("PRODUCES") if x[1] == e[1]] or [None]
        for r in made:
            takers = [x[1] for x in by("ARGUMENT") if x[2] == r] if r else []
            for c in takers or [e[1]]:
                put(e[2], c, 0 if takers else 1)
    best = {}

    def go(v, level, left, label):
        for c, via in uses[v].items():
            best.setdefault((c, level), []).append((len(left), label, via))
            if via == 1 or level == depth or p.nodes[callee[c]][2] not in V.CALLABLE:
                continue
            for e in by("ARGUMENT"):
                if e[1] == c and e[7] in param:
                    go(param[e[7]], level + 1, left, e[7])
            r = result.get(c)
            if local.get(r):
                go(local[r], level + 1, left, None)
            elif r and types.get(r) and scope[c] not in left and len(left) < min(depth, 10):
                for k in callee:
                    mine = local.get(result.get(k))
                    if callee[k] == scope[c] and mine and types.get(mine) == types[r]:
                        go(mine, level + 1, left | {scope[c]}, p.nodes[scope[k]][4])

    go(root, 1, frozenset(), None)
    out = {}
    for c in {c for c, _ in best}:
        level = min(n for x, n in best if x == c)
        rows = best[(c, level)]
        out[c] = (level, min(r[0] for r in rows), min((r[1] for r in rows if r[1]), default=None), V.VIA[min(r[2] for r in rows)])
    return out


def test_random_programs_equal_all_paths(spark):
    rnd = random.Random(11)
    for _ in range(2):
        p = Program()
        methods = [f"m{i}" for i in range(5)]
        for m in methods:
            p.node(m, "Method", f"App::{m}()")
            p.value(f"{m}.p", "parameter", m, fqn=f"App::{m}().$p")
        for t in "TU":
            p.node(t, "Class")
        p.node("prop", "Property")
        own = {m: [f"{m}.p"] for m in methods}
        for i in range(16):
            m = rnd.choice(methods)
            to = rnd.choice([*methods, "prop"])
            args = [(rnd.choice(own[m]), f"App::{to}().$p" if rnd.random() < 0.7 else None) for _ in range(rnd.choice([0, 1, 1, 2]))]
            out, loc = rnd.random() < 0.8, rnd.random() < 0.5
            p.call(f"c{i}", m, to, on=rnd.choice([None, rnd.choice(own[m])]), args=dict(args).items(), result=f"r{i}" if out else None, local=f"l{i}" if out and loc else None, type_=rnd.choice(["T", "T", "U", None]))
            own[m] += [f"r{i}"] * out + [f"l{i}"] * (out and loc)
        names = [n[1] for n in p.nodes.values() if n[2] == "Value"]
        got = defaultdict(dict)
        for (r, c), x in flows(p.graph(spark), spark, *names, depth=4).items():
            got[r][c] = x
        for v in names:
            assert got[v] == walked(p, v, 4), v
