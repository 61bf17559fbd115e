import random
from types import SimpleNamespace

from weftgraph.operators import flows as W
from weftgraph.plans.closure import closure


def shortest(pairs, most=None):
    """{(a, b): length of the shortest way from a to b, of one step at least}"""
    up: dict = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    out = {}
    for start in up:
        level, d, seen = {start}, 0, set()
        while level and (most is None or d < most):
            d += 1
            level = {b for a in level for b in up.get(a, ())} - seen
            seen |= level
            out |= {(start, b): d for b in level}
    return out


def closed(spark, pairs, most=None):
    rounds = []

    def keep(df, name):
        rounds.append(name)
        return spark.createDataFrame(df.collect(), df.schema)

    rows = closure(spark.createDataFrame(pairs, "node_id string, parent_id string"), keep, most).collect()
    got = {(r.node_id, r.ancestor_id): r.distance for r in rows}
    assert len(got) == len(rows)
    return got, rounds.count("closure-far")


def test_random_graphs_with_cycles(spark):
    rnd = random.Random(2)
    for n, m, most in ((12, 14, None), (12, 30, None), (20, 22, 5)):
        pairs = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        assert closed(spark, pairs + pairs[:3], most)[0] == shortest(pairs, most)
    assert closed(spark, [])[0] == {}


def test_a_chain_takes_logarithmic_rounds(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(70)]
    got, rounds = closed(spark, pairs)
    assert got == shortest(pairs) and rounds <= 8


def test_messages_that_only_have_targets_are_listed(spark):
    emits = spark.createDataFrame([("f1", "Message", "m1"), ("f2", "Message", "m1"), ("f1", "Event", "e1")], "flow_id string, to_label string, to_id string")
    handled = spark.createDataFrame([("Message", "m2", "f3"), ("Event", "e1", "f3")], "from_label string, from_id string, flow_id string")
    g = SimpleNamespace(emits=emits, handled_by=handled)
    assert sorted(map(tuple, W.list_entities(g, "Message").collect())) == [("m1", 2, 0), ("m2", 0, 1)]
