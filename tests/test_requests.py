import random
from types import SimpleNamespace

from weftgraph.api import Api
from weftgraph.plans.replay import breadth_first, depth_first


def test_edges_of_a_hub_suffice_for_any_walk(spark):
    """Parallel edges and a hub: walks over the edges fetched equal walks over all edges."""
    rng = random.Random(3)
    rows = [("a", f"n{i % 40:02}", "f", i) for i in range(90)] + [("n00", "a", "f", 1), ("n01", "a", "f", 1)]
    rows += [(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", "f", i) for i in range(200)]
    pairs = spark.createDataFrame(rows, "node_id string, next_id string, loc_file string, loc_line long")
    nodes = spark.createDataFrame([(n,) for n in sorted({r[0] for r in rows} | {r[1] for r in rows})], "node_id string")
    api = Api.__new__(Api)
    api.g = SimpleNamespace(nodes=nodes, keep=lambda df, *a: df)
    every: dict = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        every.setdefault(r[0], []).append((r[1], {}))
    for limit in (1, 4):
        edges = api._adjacent("a", pairs, 2, limit)
        assert len(edges["a"]) <= (2 * limit + 2) * limit
        for walk in (depth_first, breadth_first):
            shape = lambda es: [(e.node_id, shape(e.children)) for e in es]  # noqa: E731, B023
            assert shape(walk("a", lambda n: edges.get(n, []), 2, limit)) == shape(walk("a", lambda n: every.get(n, []), 2, limit))
