import math
import random

import duckdb
import numpy as np

from weftgraph.llm import sort_means as S

from . import brute


def plain(rows, k=16, rounds=3, width=64):
    kept = [(d, [math.floor(64 * float(x)) for x in v]) for d, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, brute.sha(f"1:{r[0]}"), r[1]))[:k]
    cs = [v for _, v in first]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds if cs else 0):
        of = assign()
        for i in range(len(cs)):
            own = [v for (_, v), (_, c) in zip(kept, of) if c == i]
            if own:
                cs[i] = [sum(x) // len(own) for x in zip(*own)]
    of = assign() if cs else []
    per = [sum(d for d, c in of if c == i) for i in range(len(cs))]
    return [(v[0], c, d, per[c], sum(per), S.digest(cs[c])) for v, (d, c) in zip(kept, of)]


def got(df):
    return sorted(map(tuple, S.clusters(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_whole_table_and_sql(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    want = sorted(plain(rows), key=str)
    assert got(e) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    sql = db.execute(S.OP11_SQL)
    names = [d[0] for d in sql.description]
    assert sorted((tuple(dict(zip(names, r)).values()) for r in sql.fetchall()), key=str) == want


def test_nulls_ties_and_repeated_rows(spark):
    rnd = random.Random(4)
    rows = [(i % 70, [rnd.choice([0.0, 0.02, -0.5]) for _ in range(64)]) for i in range(200)]
    rows += rows[:40] + [(None, [0.1] * 64), (None, [0.3] * 64), (900, None), (901, [0.1] * 63), (902, [float("nan")] * 64), (903, [None] + [0.1] * 63), (904, [float("inf")] * 64), (905, [])]
    df = spark.createDataFrame([(d, v, "x") for d, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    assert got(df) == sorted(plain(rows), key=str)
    few = spark.createDataFrame([(1, [0.25] * 64), (1, [0.25] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<double>")
    assert got(few) == sorted(plain([tuple(r) for r in few.collect()]), key=str)
    assert got(df.limit(0)) == []


def test_scan_stops_and_stays_exact():
    rnd = np.random.default_rng(5)
    cs = np.concatenate([rnd.integers(-400, 400, (14, 6)), np.zeros((2, 6), np.int64)])
    vs = np.concatenate([rnd.integers(-500, 500, (500, 6)), np.repeat(cs, 60, axis=0) + rnd.integers(-3, 4, (960, 6))])
    order, gap = S.seats(cs)
    every = ((vs[:, None] - cs[None]) ** 2).sum(axis=2)
    assert (order[:, 0] == np.arange(16)).all() and (np.diff(gap) >= 0).all()
    for before in (rnd.integers(0, 16, len(vs)), every.argmin(axis=1)):
        best, least, computed = S.nearest(vs, before, cs, order, gap)
        assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert computed < every.size // 2  # those that begin where they belong stop early


def test_too_large(spark):
    df = spark.createDataFrame([(1, [3.0e30] + [0.0] * 63)], "vec_id long, embedding array<float>")
    try:
        S.clusters(df).collect()
    except Exception as e:
        assert "after scaling" in str(e)
    else:
        raise AssertionError
