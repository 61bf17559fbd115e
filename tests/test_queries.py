import os

import duckdb
import pytest

from weftgraph import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("QUERY_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    out = registry.entries()[name](spark, SF)
    cols = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in out.collect()), key=repr)
    cur = db.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    for c, k in out.dtypes:
        if k == "int":
            assert kinds[c] in ("INTEGER", "NUMBER"), f"{c}: {k} and {kinds[c]}"
    assert got == want
