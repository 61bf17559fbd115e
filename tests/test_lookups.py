import random

from weftgraph.graph import Graph
from weftgraph.operators import context as C
from weftgraph.operators import lookups as L

from .test_values import Program


def test_as_of_is_the_nearest_of_all(spark):
    rnd = random.Random(4)
    left = [(rnd.choice("ab"), rnd.randrange(40), i) for i in range(120)] + [("z", 3, 999)]
    right = [(rnd.choice("abc"), rnd.randrange(40), f"h{rnd.randrange(30):02}") for _ in range(25)]
    got = L.as_of(spark.createDataFrame(left, "k string, line long, i long").repartition(3), spark.createDataFrame(right, "k string, line long, hit string").repartition(2), ["k"])
    want = {(k, line, i, h, off) for k, line, i in left for off, h in [min(((abs(at - line), h) for x, at, h in right if x == k), default=(None, None))] if h}
    assert {(r.k, r.line, r.i, r.hit, r.off) for r in got.collect()} == want
    assert got.count() == len(want)


def program():
    p = Program()
    for m in ("run", "other"):
        p.node(m, "Method", f"App::{m}()")
    for name in ("$ab", "$x", "$name", "$"):
        p.node(f"p{name}", "Property", name=name)
    p.value("v", "local", "run")
    for i, name in enumerate(("$ab", "$x", "$name", "$")):
        p.call(f"read{i}", "run", f"p{name}", on="v", kind="access")
    p.call("say", "run", "other")
    p.edges += [("ARGUMENT", "say", "v", None, None, 0, "$v->name . cab", None), ("ARGUMENT", "read1", "v", None, None, 0, "x", None)]
    return p


def test_names_of_any_length_in_arguments(spark):
    got = {r.call_id for r in C.orphan_accesses(program().graph(spark)).collect()}
    assert got == {"read1"}  # said in its own arguments only; ab, name and the empty name are in another call's


def test_order_does_not_depend_on_partitions(spark):
    p = Program()
    p.node("f", "File")
    for i in range(12):
        p.node(f"c{i:02}", "Class", line=3)
        p.edge("CONTAINS", "f", f"c{i:02}")
    for i in range(1, 12):
        for kind in ("EXTENDS", "IMPLEMENTS"):
            p.edge(kind, f"c{i:02}", "c00")
    g = p.graph(spark)
    rows = lambda h: sorted(map(tuple, C.used_by(h).collect()))
    first = rows(g)
    assert len(first) == 22
    for n in (1, 5):
        assert rows(Graph(spark, g._nodes.repartition(n), g._edges.repartition(n, "type"))) == first


def test_strategies_of_a_call_lookup(spark):
    p = Program()
    p.node("K", "Class")
    p.node("K.ctor", "Method", name="__construct")
    p.edge("CONTAINS", "K", "K.ctor")
    for m in ("run", "far"):
        p.node(m, "Method", f"App::{m}()", line=9)
    p.node("do", "Method")
    p.call("c1", "run", "do")
    p.call("new", "run", "K.ctor", kind="constructor")
    p.edge("USES", "run", "do", loc_line=4)
    p.edge("USES", "far", "do", loc_line=2)
    p.edge("USES", "run", "K")
    p.edge("USES", "far", "K")
    got = {(r.source_id, r.target_id): (r.strategy, r.call_id, r.off) for r in L.nearest_call(p.graph(spark)).collect()}
    assert got == {("run", "do"): (1, "c1", 3), ("far", "do"): (2, "c1", 1), ("run", "K"): (3, "new", 8)}
