import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import trees as T
from weftgraph.plans.replay import depth_first

from .test_trees import by_root, flow_program, flowed, rows_of


@pytest.mark.parametrize("lists", [2, 8])
def test_walks_are_given_few_lists_and_more_where_they_lack_some(spark, monkeypatch, lists):
    rnd = random.Random(lists)
    ids = [f"n{i:02}" for i in range(60)]
    rows = [(rnd.choice(ids), rnd.choice(ids), "a", i) for i in range(700)] + [("lone", "n01", "a", 1), ("lone", "leaf", "a", 2)]
    df = spark.createDataFrame(rows, "node_id string, next_id string, loc_file string, loc_line long")
    near = T.neighbours(df, 30)
    starts = near.select(F.col("node_id").alias("root_id"), "nexts")
    rounds = []

    def keep(d, name):
        rounds.append((name, spark.createDataFrame(d.collect(), d.schema)))
        return rounds[-1][1]

    monkeypatch.setattr(T, "LISTS", lists)
    got = by_root(T.walks(near, starts, 3, 30, keep))
    every = defaultdict(list)
    for a, b, file, at in rows:
        every[a].append((b, {"loc_file": file, "loc_line": at}))
    assert got == {r: rows_of(depth_first(r, lambda n: every.get(n, []), 3, 30), r) for r in every}
    asked = T._first_lists(near, starts, 3, lists).groupBy("root_id").count().agg(F.max("count")).first()[0]
    assert asked <= lists
    tried = [d for name, d in rounds if name == "tree-walks"]
    if lists == 8:
        assert tried[0].where("place = 0").count() < len(every) / 2


def test_execution_flow_keeps_no_paths_beyond_its_count(spark):
    p = flow_program(12, 3)
    g, limit, kept = p.graph(spark), 10, []
    keep = g.keep
    g.keep = lambda df, name, *by: kept.append((name, keep(df, name, *by))) or kept[-1][1]
    got = defaultdict(list)
    for r in T.execution_trees(g, 3, limit).collect():
        got[r.root_id].append((r.place, r.depth, r.parent_id, r.call_id, r.callee_id, r.local_id))
    for m in (f"m{i}" for i in range(12)):
        assert sorted(got[m]) == flowed(p, m, 3, limit), m
    levels = [d for name, d in kept if name == "flow-level"]
    assert levels[1].groupBy("root_id").count().agg(F.max("count")).first()[0] < limit
