import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from weftgraph.llm import partenum as P

from . import brute
from .test_minhash import crowd


def plain(rows, percent=80):
    """(doc_id, n_shingles, component_id)"""
    sets = [(d, brute.shingles(t)) for d, t in rows]
    top = {d: d for d, _ in sets if d is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    where, of = defaultdict(list), {}
    for k, (d, s) in enumerate(sets):
        if d is None or not s:
            continue
        if (first := of.setdefault(frozenset(s), d)) != d:
            a, b = root(first), root(d)
            top[max(a, b)] = min(a, b)
            continue
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
            where[g].append(k)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = root(d), root(sets[j][0])
                top[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(parts)
    got = sorted(map(tuple, P.joined_groups(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == plain(rows)


def test_whole_table_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert sorted(map(tuple, P.op13_partenum_join(spark, sf).collect()), key=str) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.execute(P.OP13_SQL).fetchall(), key=str) == want


def test_linked_sets_share_a_signature():
    rnd = np.random.default_rng(7)
    for size in (4, 5, 6, 9, 10, 17, 40, 41, 99, 350, 1200, 5000):
        for _ in range(60):
            diff = int(size * 0.2)
            less = int(rnd.integers(0, diff + 1))
            union = rnd.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, size, dtype=np.uint64)
            a, b = np.sort(union[: size - less]), np.sort(union[diff - less :])  # they differ in diff of size
            sig, of = P.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert diff == 0 or set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (size, less)


def test_sparse_hashes_still_share_a_signature():
    """Sets whose hashes crowd into few groups, so that most choices are empty."""
    rnd = np.random.default_rng(8)
    for size in (10, 60, 400):
        for _ in range(40):
            union = np.unique(rnd.integers(0, 1 << 58, size, dtype=np.uint64))
            diff = len(union) // 5
            a, b = union, np.delete(union, rnd.choice(len(union), diff, replace=False))
            sig, of = P.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_edited_copies_nulls_and_repeated_rows(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(8):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 7, 30, 80, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = f"E{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.2 else "\n".join(w)))
    rnd.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  two"), (905, "É"), (906, "é"), (None, "one two"), (None, None)]
    check(spark, rows + rows[:5])
    check(spark, [])


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    check(spark, [(3, a), (5, b), (5, a), (9, b), (None, a)])


def test_crowded_signatures(spark):
    check(spark, crowd(500, 3), 8)


def test_buckets_lose_nothing(spark, monkeypatch):
    """Small flushes and buckets: signatures that meet in a task, across tasks, and both."""
    rnd = random.Random(6)
    base = [[f"g{g}w{i}" for i in range(60)] for g in range(5)]
    rows = []
    for i in range(300):
        w = list(base[i % 5])
        w[rnd.randrange(60)] = f"e{i % 40}"
        rows.append((i, " ".join(w)))
    sig, key = np.array([5, 9, 5, 5, 7, 9], P.U) << P.U(60), np.array([1, 2, 1, 3, 4, 2], P.U)
    packed = P._packed(sig, key, 8, 0)
    assert [np.frombuffer(s, P.U).size for _, whole, s, _ in packed if whole] == [2]
    assert sorted(int(x) >> 60 for _, whole, s, _ in packed if not whole for x in np.frombuffer(s, P.U)) == [5, 7, 9]
    check(spark, rows, 11)


def test_very_long_texts(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(3000)}" for _ in range(80_000)]
    check(spark, [(1, " ".join(words)), (2, " ".join(words[:75_000])), (3, " ".join(words[:40_000]))])


def test_dealt_signatures_are_short_and_meet_as_whole_ones_do():
    rnd = np.random.default_rng(7)
    sig = np.sort(rnd.integers(0, 1 << 64, 4096, np.uint64)) & P.MASK
    short = P._short(sig.tobytes())
    assert (P._long(short) == sig).all() and len(short) <= 6 * len(sig)
    text = " ".join(f"w{i}" for i in rnd.integers(0, 500, 2000))
    rows = next(P._deal(4)(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])))
    sets, edges = P.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    want = np.unique(P.signatures(sets, edges)[0] & P.MASK)
    got = [P._long(s.as_py()) for s in rows.column("sigs")]
    assert (np.sort(np.concatenate(got)) == want).all()
    assert sum(len(s.as_py()) for s in rows.column("sigs")) <= 6 * len(want)


def test_buckets_of_a_task_are_laid_out_one_at_a_time(monkeypatch):
    rnd = np.random.default_rng(9)
    sig, key = rnd.integers(0, 1 << 64, 6000, np.uint64) & P.MASK, rnd.integers(0, 1 << 64, 6000, np.uint64)
    halves = [(np.concatenate([sig[:4000], sig[:9]]), np.concatenate([key[:4000], key[9:18]])), (sig[2000:], key[2000:] + P.U(1))]
    rows = [(b, w, P._short(s), k) for pair in halves for b, w, s, k in P._packed(*pair, 64, 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["bucket", "whole", "sigs", "sets"]) for part in (rows[:50], rows[50:])]
    laid, distinct = [], P._distinct
    monkeypatch.setattr(P, "_distinct", lambda s, k: laid.append(len(s)) or distinct(s, k))
    got = {(int(np.int64(s)), int(np.int64(k))) for b in P._meet(iter(batches)) for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    both = [(s, k) for s, k in zip(sig[2000:4000], key[2000:4000])] + [(s, k + P.U(1)) for s, k in zip(sig[2000:4000], key[2000:4000])]
    twice = [(s, k) for s, k in zip(sig[:9], key[:9])] + [(s, k) for s, k in zip(sig[:9], key[9:18])]
    assert got == {(int(s.view(np.int64)), int(k.view(np.int64))) for s, k in both + twice}
    assert sum(laid) >= 8000 and max(laid) < 400
