import random
import re

import numpy as np
import pytest

from weftgraph.llm import decontaminate as D


def normal(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").encode()


def least_edits(item: bytes, doc: bytes) -> int:
    """Sellers' algorithm."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in doc:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def expected(docs, items, edits):
    out = set()
    for d, t in docs:
        for i, x in items:
            if t is not None and x is not None and len(normal(x)) >= D.LEAST:
                n = least_edits(normal(x), normal(t))
                if n <= len(normal(x)) * edits // 100:
                    out.add((d, i, n))
    return out


@pytest.mark.parametrize("edits,q", [(10, 8), (20, 4), (0, 8)])
def test_edited_passages(spark, edits, q):
    rnd = random.Random(edits + 1)
    say = lambda n: "".join(rnd.choice("abcd é\n") for _ in range(n))
    items = [(i, say(rnd.choice([10, 18, 30, 60, 120]))) for i in range(12)] + [(50, None), (51, ""), (0, say(40))]
    docs = []
    for d in range(60):
        x = list(rnd.choice(items)[1] or "")
        for _ in range(rnd.randrange(8)):
            if x:
                k = rnd.randrange(len(x))
                x[k : k + rnd.randrange(2)] = rnd.choice(["", "z", "ab", " "])
        docs.append((d, say(rnd.randrange(60)) + "".join(x).upper() + say(rnd.randrange(60))))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[4][1] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as begin").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    for size in (D.BLOCK_BYTES, 100):
        got = D.contaminated(df, bench, edits, q, size).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in got} == expected(docs, items, edits)
    texts = {d: t for d, t in docs if d not in (102, None)}
    want = dict(items[:12])
    for r in got:
        if r.doc_id in texts and r.item_id != 0:
            piece = normal(texts[r.doc_id].encode()[r.begin : r.end].decode(errors="replace"))
            assert least_edits(normal(want[r.item_id]), piece) <= r.edits + 4


def test_whole_table_holds_every_planted_item(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = {(d, i) for d, t in docs for i, x in items if normal(x) in normal(t)}
    got = {(r.doc_id, r.item_id): r.edits for r in D.op9_decontaminate(spark, sf).collect()}
    assert plain and {k for k, n in got.items() if n == 0} == plain
    for (d, i), n in got.items():
        assert least_edits(normal(dict(items)[i]), normal(dict(docs)[d])) == n


def test_normal_form():
    for t in ("", " ", "a", " A  b\n", "\t\tÉ x ", "x"):
        assert D.normal_bytes(t) == normal(t)
    raw = [b" a ", b"", b"  ", b"b", b"c  d", b" "]
    low, edges, at = D.normal(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert [low[s:e].tobytes() for s, e in zip(edges, edges[1:])] == [b"a", b"", b"", b"b", b"c d", b""]


def test_empty_tables_and_filter(spark):
    docs = spark.createDataFrame([(1, "x" * 40, "k"), (2, "some quite other text", None), (None, "x" * 40, "k"), (None, "clean", "c"), (None, None, "n")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, "X" * 30)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id or "") for r in D.without_leaks(docs, bench).collect()) == [(0, "c"), (0, "n"), (2, "")]
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), bench).count() == 0


def test_short_items_are_found(spark):
    items = [(1, "Paris"), (2, "x"), (3, "forty two"), (4, "12 monkeys"), (5, "the white dog"), (6, "abcdefghijklmno"), (7, " \n")]
    docs = [(1, "It was  PARIS."), (2, "forty\ntwo 12 monkoys"), (3, "a whte dog and the whte dog"), (4, "abcdefghXjklmno"), (5, "forty tw"), (6, ""), (7, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in D.contaminated(df, bench).collect()}
    assert got == expected(docs, items, D.EDITS) == {(1, 1, 0), (2, 3, 0), (2, 4, 1), (3, 5, 1), (4, 2, 0), (4, 6, 1)}
