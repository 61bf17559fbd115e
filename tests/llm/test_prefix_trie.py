import random
import zlib
from collections import defaultdict

import duckdb

from weftgraph.llm import prefix_trie as T

from . import brute

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        path = tuple(own.get(base, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(brute.WORD.findall(p[-1][1])) if p else 0)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], brute.sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, key int").repartition(parts)
    assert sorted(map(tuple, T.trie(df).select(*COLUMNS).collect()), key=str) == sorted(plain(rows), key=str)


def test_whole_table_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(plain(rows), key=str)
    assert sorted(map(tuple, T.op12_prefix_trie(spark, sf).select(*COLUMNS).collect()), key=str) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    sql = db.execute(T.OP12_SQL)
    at = [[d[0] for d in sql.description].index(c) for c in COLUMNS]
    assert sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=str) == want


def test_nulls_ties_copies_and_turnless(spark):
    rnd = random.Random(2)
    rows = []
    for c in [*range(-45, 90), 1 << 60]:
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, rnd.choice([t, t, t, None, 1]), rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a b", " c\td e ", "", None])))
    rows += rows[:50] + [(None, 1, "user", "x")] + [(c, t, "user", "same words here") for c in range(200, 240) for t in range(6)]
    rnd.shuffle(rows)
    check(spark, rows)
    check(spark, [])
    check(spark, [(5, None, None, None)])


def test_long_conversations_and_long_texts(spark):
    rows = [(c, t, "user", f"t{t if t < 150 else (c, t)}") for c in (0, 20, 40) for t in range(300)]
    rows += [(60, t, "user", f"t{t}") for t in range(129)] + [(80, t, "user", f"t{t}") for t in range(64)] + [(100, 0, "user", "w " * 300_000), (120, 0, "user", "w " * 300_000)]
    check(spark, rows)


def test_ends_of_a_crowded_node(spark):
    n = 3 * T.PIECE + 5
    ends = spark.range(-7, n - 7).selectExpr("cast('k' as binary) as key", "id as conv_id").union(spark.sql("select cast('a' as binary), 3L")).repartition(7)
    got = {bytes(r.key): r.ends_sha256 for r in T.end_digests(ends).collect()}
    assert got == {b"k": brute.sha(",".join(map(str, range(-7, n - 7)))), b"a": brute.sha("3")}


def test_rollup_of_a_chain(spark):
    n = 700
    nodes = spark.range(n).selectExpr("cast(string(id) as binary) as key", "if(id = 0, null, cast(string(id - 1) as binary)) as parent", "id as depth", "1L as one")
    assert {r.key.decode(): r.one for r in T.rolled_up(nodes, ["one"]).collect()} == {str(i): n - i for i in range(n)}
