import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import substring_dedup as S

from . import brute


def check(spark, rows, size=50, gram=25):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, S.substring_dedup(df, size, gram).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == sorted(brute.substring(rows, size), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, S.op2_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == sorted(brute.substring(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))] for _ in range(5)]
    rows = []
    for i in range(30):
        w = list(rnd.choice(base)) + (rnd.choice(base) if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(0, 3)):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(["x", "é", "\x1c"])
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    check(spark, rows, 8, 4)


def test_edges(spark):
    long = " ".join(f"w{i % 7}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (5, long), (6, long), (6, long), (7, "q " + long), (None, long), (8, long[:200])]
    check(spark, rows)
    check(spark, [])


def test_other_columns_stay(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "a", 1, 2), (2, "z " + text + "  end", None, 3, 4)], "doc_id long, text string, spans string, tag long, key long")
    out = {r.doc_id: r for r in S.without_repeats(df).collect()}
    assert out[1].text == text and out[2].text == "z end" and out[2].spans is None and out[1].tag == 1
    assert S.without_repeats(df).columns == df.columns
    assert S.without_repeats(df.select("doc_id", "text").where(F.lit(False))).count() == 0


def test_words_that_meet_modulo_a_power_of_two(spark):
    one, two = brute.thue_morse(4096)
    around = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*around, w, *around])) for i, w in enumerate((one, two))]
    a, b = ("x" if c == "a" else "y" for c in one), ("y" if c == "a" else "x" for c in one)
    check(spark, [*rows, (8, " ".join(a)), (9, " ".join(b))])


def test_starts_beyond_32_bits():
    import numpy as np

    start, n = np.array([0, 1 << 27, (1 << 42) + 5]), np.array([1, 7, 1 << 19])
    spans = S.pack(start, n)
    assert (spans >> S.SHIFT).tolist() == start.tolist() and (spans & S.WINDOWS).tolist() == n.tolist()


def test_a_row_that_stands_many_times(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(2, text)] * 400 + [(3, text + " more")] * 400 + [(1, "q " + text[:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = S.removal_spans(df).collect()
    assert sum(len(r.spans) for r in spans) <= 2 * 90  # a window once a text, however often the text stands
    check(spark, rows)


def test_very_long_texts(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["q"] * 40_000 + words[50_000:90_000])), (3, " ".join(words[:60_000] + ["new"] + words[60_000:]))]
    check(spark, rows)
