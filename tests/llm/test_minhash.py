import random

import numpy as np

from weftgraph.llm import minhash as M
from weftgraph.llm.components import components

from . import brute


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, M.similar_groups(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted(brute.near(rows), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, M.op6_minhash_near_dedup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == sorted(brute.near(rows))


def test_edited_copies(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 7, 80, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = f"E{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.2 else "\n".join(w)))
    rnd.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "One  two"), (905, "É"), (906, "é")]
    check(spark, rows + rows[:5])
    check(spark, [])


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, a), (5, b), (5, a), (9, b), (None, a)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in M.similar_groups(df).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (None, None, True)}


def test_first_of_groups_keeps_columns(spark):
    a = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(3, a, 1, "x"), (5, a, 2, None)], "doc_id long, text string, component_id int, kept string")
    assert [tuple(r) for r in M.first_of_groups(df).collect()] == [(3, a, 1, "x")]


def test_sketches_lose_no_link_and_tell_apart(spark):
    rnd = np.random.default_rng(1)
    rows, want = [], {}
    for n in (1, 3, 4, 20, 150, 600, 3000):
        for j in (0.76, 0.3):
            for _ in range(60):
                k = int(n * (1 - j) / (1 + j))
                both = rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
                a, b = (np.unique(np.concatenate([both[: n - k], rnd.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)])) for _ in range(2))
                s, f = M.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                rows.append((len(rows), len(a), int(f[0]), s[0].tolist(), len(b), int(f[1]), s[1].tolist()))
                want[len(rows) - 1] = (n, j)
    df = spark.createDataFrame(rows, "id int, n_shingles long, filled long, sketch array<long>, n_shingles_b long, filled_b long, sketch_b array<long>")
    passed = {r.id for r in df.where(M._may_link()).collect()}
    assert all(i in passed for i, (n, j) in want.items() if j > 0.75)
    assert not any(i in passed for i, (n, j) in want.items() if j == 0.3 and n >= 150)


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7), (-5, 300)]
    got = {r.id: r.group for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {}

    def root(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(top)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_that_meet_modulo_a_power_of_two(spark):
    one, two = brute.thue_morse(2048)
    check(spark, [(1, f"a b {one} c"), (2, f"a b {two} c"), (3, one), (4, two)])


def crowd(n, seed):
    """n near copies of one text, and n unlinked texts of which 60 % is one boilerplate passage."""
    rnd = random.Random(seed)
    base, common = [f"b{i}" for i in range(120)], [f"c{i}" for i in range(104)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        rows.append((2 * i, " ".join(w)))
        own = [f"u{i}x{j}" for j in range(30)]
        rows.append((2 * i + 1, " ".join(common + own)))
    rows.append((2 * n + 1, " ".join(common + own[:-1] + ["last"])))  # linked with the unlinked text before it only
    return rows


def test_crowded_buckets(spark):
    rows = crowd(700, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in M.similar_groups(df).collect()}
    want = {r[0]: r[2] for r in brute.near(rows)}
    assert sum(got[d] == c for d, c in want.items()) >= 0.99 * len(want)
    assert got == want


def test_one_row_many_times(spark):
    text, near = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(79))
    check(spark, [(4, text)] * 400 + [(3, near)] * 400 + [(9, "other words that are alone here")] * 5)


def test_very_long_texts(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(3000)}" for _ in range(80_000)]
    check(spark, [(1, " ".join(words)), (2, " ".join(words[:75_000])), (3, " ".join(words[:40_000]))])
