import random
from collections import Counter

import pytest

from weftgraph.llm import suffix_dedup as S

from . import brute


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, S.suffix_dedup(df, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == sorted(brute.byte_repeats(rows, kw.get("size", 200)), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, S.op5_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == sorted(brute.byte_repeats(rows))


@pytest.mark.parametrize("hot_bytes", [1 << 18, 60])
def test_random_edits(spark, hot_bytes):
    rnd = random.Random(hot_bytes)
    base = ["".join(rnd.choice("abcé \n") for _ in range(rnd.randint(0, 90))) for _ in range(4)]
    rows = []
    for i in range(30):
        w = list(rnd.choice(base) + (rnd.choice(base) if rnd.random() < 0.4 else ""))
        for _ in range(rnd.randint(0, 3)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(["x", "", "zz"])
        rows.append((i, "".join(w)))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (3, rows[3][1]), (3, "ab" * 40), (200, "a" * 500)]
    check(spark, rows, size=16, grams=(6, 11, 16), bucket_bytes=500, hot_bytes=hot_bytes)


def test_hot_keys_are_cut_by_longer_grams(spark):
    """One passage among many others: its key has too many different runs for a bucket at every length but the last."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, tails = word(190), [word(120) for _ in range(12)]
    rows = [(i, word(60) + passage + rnd.choice(tails)) for i in range(60)] + [(90, "a" * 700), (91, "ab" * 300), (92, "a" * 900)]
    for hot_bytes in (1, 2000, 1 << 22):
        check(spark, rows, hot_bytes=hot_bytes)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, "short"), (2, None)])


@pytest.mark.parametrize("shard_bytes", [1, 50, 1 << 20])
def test_merge_of_shards(shard_bytes):
    rnd = random.Random(3)
    for _ in range(20):
        runs = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(12))]
        runs += runs[:2]
        n = Counter(r[i : i + 8] for r in runs for i in range(len(r) - 7))
        want = {(k, i) for k, r in enumerate(runs) for i in range(len(r) - 7) if n[r[i : i + 8]] > 1}
        run, offset = S.repeated(runs, 8, shard_bytes)
        assert set(zip(run.tolist(), offset.tolist())) == want and len(run) == len(want)


def test_suffix_array():
    import numpy as np

    text = np.array(list(b"banana") + [0] + list(b"ananas") + [0], np.uint16)
    order = S.suffix_array(text, 200)
    key = lambda i: [(0, j) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))]
    assert order.tolist() == sorted(range(len(text)), key=key)


def test_bytes_that_meet_modulo_a_power_of_two(spark):
    one, two = brute.thue_morse(4096)
    check(spark, [(1, "start " + one), (2, "other " + two), (3, "x" * 150 + one[:2048]), (4, "y" * 150 + two[:2048])])


def test_a_row_that_stands_many_times(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdef ") for _ in range(900))
    rows = [(2, text)] * 300 + [(3, text[:450] + "!" + text[450:])] * 300 + [(4, text[100:350] + "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = df.selectExpr("xxhash64(doc_id, text) as doc", "xxhash64(text, doc_id) as tag", "text")
    assert sum(len(r.spans) for r in S.repeated_spans(own).collect()) < 100
    check(spark, rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab" * 150, 5, "x", 6), (2, "ab" * 150, None, None, 7)], "doc_id long, text string, doc long, tag string, spans int")
    assert [r.n_removed for r in S.suffix_dedup(df).collect()] == [300, 300]


def test_very_long_text(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(400_000))
    check(spark, [(1, text), (2, text[1000:300_000]), (3, "ab" * 60_000)])
