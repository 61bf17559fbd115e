import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators.reconcile import applied, reconcile, replace_edges
from weftgraph.operators.search import search_all
from weftgraph.operators.texts import MARKER, chunks, enrich, pack, upsert_explanations
from weftgraph.plans.closure import closure
from weftgraph.plans.expand import expand
from weftgraph.plans.replay import breadth_first, by_path, depth_first
from weftgraph.streaming.reconcile import KeyedTable, emit_counts

graphs = st.dictionaries(st.integers(0, 8), st.lists(st.integers(0, 8), max_size=4), max_size=9)


def flat(entries):
    return [(e.node_id, e.depth) for x in entries for e in [x]] + [y for x in entries for y in flat(x.children)]


@given(graphs, st.integers(1, 5), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_walks(g, depth, limit):
    edges = lambda n: [(m, {}) for m in g.get(n, [])]
    for walk in (depth_first, breadth_first):
        got = flat(walk(0, edges, depth, limit))
        assert len(got) <= limit and all(1 <= d <= depth for _, d in got)
    first = [n for n, _ in flat(depth_first(0, edges, depth, limit))]
    assert len(first) == len(set(first)) and 0 not in first
    far = {0: 0}
    todo = [0]
    for n in todo:
        for m in g.get(n, []):
            if m not in far:
                far[m] = far[n] + 1
                todo.append(m)
    for n, d in flat(breadth_first(0, edges, depth, 10**6)):
        assert far[n] <= d
    assert {n for n, _ in flat(breadth_first(0, edges, depth, 10**6))} - {0} == {n for n, d in far.items() if 0 < d <= depth}

    def paths(entries, above):
        for e in entries:
            assert e.node_id not in above
            paths(e.children, above | {e.node_id})

    paths(by_path(0, edges, depth, 50), {0})


def test_closure_of_a_cycle(spark):
    n = [0]

    def keep(df, name, *by):
        n[0] += 1
        return spark.createDataFrame(df.collect(), df.schema)

    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "node_id string, parent_id string")
    got = {(r.node_id, r.ancestor_id): r.distance for r in closure(pairs, keep).collect()}
    assert got["a", "a"] == 3 and got["x", "c"] == 3 and got["a", "b"] == 1 and len(got) == 12
    assert max(r.distance for r in closure(pairs, keep, 2).collect()) == 2
    start = spark.createDataFrame([("r", "x"), ("q", "b")], "root_id string, node_id string")
    e = {(r.root_id, r.node_id): r.depth for r in expand(start, pairs.withColumnRenamed("parent_id", "next_id"), 2, keep).collect()}
    assert e == {("r", "a"): 1, ("r", "b"): 2, ("q", "c"): 1, ("q", "a"): 2}


def test_packing(spark):
    methods = ["m" * 60, "n" * 60, "o" * 200, "p" * 10]
    text = "class X {\n" + "\n".join(methods)
    got = pack(text, methods, 1, 60)
    assert all(c.startswith("class X {\n") for c in got) and "".join(got).count("m" * 60) == 1 and len(got) >= 2
    assert pack("short", methods, 1, 60) == ["short"]
    assert pack(text, [], None, 10) == [text[:40] + MARKER]
    rows = spark.createDataFrame([("a", "Class", text, methods, 1), ("b", "Method", "x" * 500, None, None), ("c", "Class", "s", None, None)], "node_id string, kind string, text string, methods array<string>, first_method long")
    out = [(r.node_id, r.chunk_index, r.content) for r in chunks(rows, 60).orderBy("node_id", "chunk_index").collect()]
    assert [c for n, _, c in out if n == "a"] == got and [c for n, _, c in out if n == "b"] == ["x" * 240 + MARKER]


def test_reconcile_keeps_and_repeats(spark):
    now = spark.createDataFrame([(1, "a", "note"), (2, "b", None), (3, "c", "old")], "id int, name string, note string")
    want = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id int, name string")
    plan = reconcile(now, want, "id", ["note"])
    assert {r.id: (r.action, r.name, r.note) for r in plan.collect()} == {1: ("unchanged", "a", "note"), 2: ("updated", "B", None), 3: ("deleted", "c", "old"), 4: ("created", "d", None)}
    again = reconcile(applied(plan), want, "id", ["note"])
    assert {r.action for r in again.collect()} == {"unchanged"}
    edges = spark.createDataFrame([("A", 1), ("B", 2)], "type string, x int")
    assert sorted(map(tuple, replace_edges(edges, spark.createDataFrame([(5,)], "x int"), "A").collect())) == [("A", 5), ("B", 2)]


def test_enrichment(spark):
    def explain(fqn, source):
        if fqn == "bad":
            raise ValueError("no")
        return fqn.upper()

    rows = spark.createDataFrame([("1", "ok", "s"), ("2", "bad", "s")], "node_id string, fqn string, source string")
    out = enrich(rows, explain, lambda t: [1.0])
    assert {(r.node_id, r.status, r.error) for r in out.collect()} == {("1", "done", None), ("2", "failed", "no")}
    nodes = spark.createDataFrame([("1", "A"), ("2", "B")], "node_id string, name string")
    got = {r.node_id: (r.explanation, r.explain_model) for r in upsert_explanations(nodes, out, "m").collect()}
    assert got == {"1": ("OK", "m"), "2": (None, None)}


def test_search_merges_collections(spark):
    v = spark.createDataFrame([(1, "a", "n1", [1.0, 0.0]), (2, "b", "n1", [0.9, 0.1]), (3, "b", "n2", [0.0, 1.0]), (4, "a", "n3", [0.0, 0.0]), (5, "a", "n4", None)], "vec_id long, collection string, node_id string, embedding array<float>")
    assert [(r.node_id, r.vec_id) for r in search_all(v, [1.0, 0.0]).collect()] == [("n1", 1), ("n2", 3)]


def test_keyed_table_and_stream(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "id", "at")
    batch = lambda rows: spark.createDataFrame(rows, "id int, at int, name string, deleted boolean")
    t.apply(batch([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "x", None)]), 0)
    t.apply(batch([(2, 3, "x", True), (1, 1, "late", False), (3, 1, "n", False)]), 1)
    want = {(1, 2, "b"), (3, 1, "n")}
    assert set(map(tuple, t.read().select("id", "at", "name").collect())) == want
    t.apply(batch([(9, 9, "again", False)]), 1)
    assert set(map(tuple, t.read().select("id", "at", "name").collect())) == want
    batch([(5, 1, "s", False)]).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    s = KeyedTable(spark, f"file://{tmp_path}/s", "id", "at")
    q = s.start(spark.readStream.schema("id int, at int, name string, deleted boolean").parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert [tuple(r) for r in s.read().select("id", "name").collect()] == [(5, "s")]
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 0, i), "click", 1.5) for i in range(3)], "ts timestamp, event_type string, value double")
    assert [(r.n, r.total) for r in emit_counts(ev).collect()] == [(3, 4.5)]


@pytest.mark.parametrize("seed", range(3))
def test_pack_never_loses_a_method(seed):
    rnd = random.Random(seed)
    methods = [f"<{i}>" + "z" * rnd.randrange(80) for i in range(30)]
    got = pack("c\n" + "\n".join(methods), methods, 1, 80)
    joined = "".join(got)
    assert all(joined.count(f"<{i}>") == 1 for i in range(30))
