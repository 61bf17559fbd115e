import math
import re
from collections import Counter

import xxhash

from weftgraph.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(x, seed=42):
    return xxhash.xxh64(x.encode(), seed=seed).intdigest()


def long_hash(v, seed):
    return xxhash.xxh64(v.to_bytes(8, "little"), seed=seed).intdigest()


def grams(w):
    one = [h(x) for x in w]
    return [x & (Q.BUCKETS - 1) for x in one + [long_hash(b, long_hash(a, 42)) for a, b in zip(one, one[1:])]]


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(three)
    again = {i + k for i, x in enumerate(three) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def expected(docs, labels):
    good = set(d for d, q in labels if q == 1)
    raw, target = Counter(), Counter()
    for d, t in docs:
        g = grams(WORD.findall(t or ""))
        raw.update(g)
        if d in good:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    base = math.log((n + Q.BUCKETS) / (m + Q.BUCKETS))
    out = []
    for d, t in docs:
        g = grams(WORD.findall(t or ""))
        llr = sum(math.log((target[b] + 1) / (raw[b] + 1)) + base for b in g) / len(g) if g and m else 0.0
        c = counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((d, *c, failed, round(llr, 6), not failed and llr >= Q.THRESHOLD))
    return sorted(out, key=str)


def rated(df, labels):
    return sorted([(*tuple(r)[:-2], round(r.llr, 6), r.kept) for r in Q.rate(df, labels).collect()], key=str)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    got = sorted([(*tuple(r)[:-2], round(r.llr, 6), r.kept) for r in Q.op1_quality_rules(spark, sf).collect()], key=str)
    assert got == expected(docs, labels)


def test_edges(spark):
    long = " ".join(f"w{i % 50001}" for i in range(70000))  # past the packed sort
    rows = [(1, None), (2, ""), (3, " \n \t"), (4, "one"), (5, "a b a b a b"), (6, "x y z\nx y z\n\n \nx y z"), (7, "# $ % *|<>& é\x1cé \x85"), (8, long), (8, long), (None, "n n n n"), (9, "a b c d a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "'q' as words", "2.0 as llr").repartition(2)
    labels = spark.createDataFrame([(4, 1), (7, 1), (7, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert rated(df, labels) == expected(rows, [(4, 1), (7, 1)])
    assert {r[-2] for r in rated(df, labels.limit(0))} == {0.0}
    assert rated(df.limit(0), labels) == []


def test_every_good_document_counts(spark):
    docs = [(i, f"a{i % 7} b{i % 11} c{i % 13}") for i in range(24_000)]
    labels = [(i, int(i % 50 != 0)) for i in range(24_000)]  # 23,520 are good
    got = rated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert got == expected(docs, labels)
