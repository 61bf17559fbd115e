import random

import duckdb
import pytest

from weftgraph import registry
from weftgraph.graph import ProjectedGraph, projected
from weftgraph.plans.closure import closure, forest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """sf with an order of a customer that isn't there, and one order twice."""
    at = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        rows = f"SELECT * FROM '{sf}/{t}.parquet'"
        if t == "orders":
            rows = f"SELECT * REPLACE (CASE WHEN o_orderkey = 5 THEN 999999 ELSE o_custkey END AS o_custkey) FROM ({rows}) UNION ALL SELECT * FROM ({rows}) WHERE o_orderkey = 7"
        duckdb.sql(f"COPY ({rows}) TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["type_counts", "owners_all", "call_arguments"])
def test_edges_are_those_of_the_sql_where_keys_miss_or_repeat(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    out = registry.entries()[name](spark, odd)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_edges_of_a_type_are_read_without_a_shuffle(spark, sf):
    g = projected(spark, sf)
    for t in ("TYPE_OF", "PRODUCES", "RECEIVER", "CONTAINS", "ASSIGNED_FROM", "USES"):
        plan = g.of_type(t)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, t


def test_a_forest_is_the_closure_of_all_its_pairs(spark):
    rnd = random.Random(4)
    inner = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 30)]
    outer = [(f"leaf{i}", f"n{rnd.randrange(40)}") for i in range(80)]
    frame = lambda rows: spark.createDataFrame(rows, "node_id string, parent_id string")
    keep = lambda df, name: spark.createDataFrame(df.collect(), df.schema)
    got = forest(frame(inner), frame(outer), keep).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, closure(frame(inner + outer), keep).collect()))


def test_nodes_that_are_no_values_are_read_without_numbering_values(spark, sf):
    g = ProjectedGraph(spark, sf)
    assert g.of_kind("Method", "Property").count() > 0 and g.ends("target", "TYPE_HINT").count() > 0
    assert g.containing("Method", "Call").count() > 0
    assert "_values" not in vars(g.source)
