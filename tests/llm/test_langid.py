import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid as L


def test_gradients_are_right():
    net = L.Network(3, 7)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    x = L.symbols([b"abc", b"xyz", b"bca", b"\xff\x00a"])
    y = np.array([0, 1, 2, 1])

    def loss():
        p = net.probabilities(x)
        return -np.log(p[:, np.arange(4), y]).mean()

    rng = np.random.default_rng(0)
    for name, g in zip(net.NAMES, net.gradients(x, y)):
        w = getattr(net, name)
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape) if name != "emb" else (rng.choice(x.ravel()), rng.integers(0, L.DIM))
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3 * max(1, abs(g[at]) * 10), name


def test_pooling_equals_reading_window_by_window(monkeypatch):
    monkeypatch.setattr(L, "SPAN", 20)
    monkeypatch.setattr(L, "READ", 7)
    net = L.Network(4, 3)
    net.out = net.out * 3
    texts = ["ab cd ab\n" + "z" * 60, "", "  ", "é ab", "x" * 20, "The quick brown fox " * 40]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = L.pooled(net, np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, r in enumerate(raw):
        total = np.zeros(4)
        for at in range(0, len(r), 20):
            begin, end = max(0, at - L.MARGIN), min(len(r), at + 20 + L.MARGIN)
            p = net.probabilities(L.symbols([r[begin:end]]))[:, 0]
            total += p[at - begin : min(at + 20, len(r)) - begin].sum(0)
        assert np.allclose(got[i], total / max(len(r), 1), atol=1e-5)


def test_state_crosses_words():
    net = L.Network(3, 5)
    one, two = (net.probabilities(L.symbols([t]))[-3:, 0] for t in (b"aa the", b"zz the"))
    assert not np.allclose(one, two, atol=1e-6)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = L.op10_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n


@pytest.mark.parametrize("rows", [[], [(1, "x", None)]])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(df, L.learn(df)).collect()] == [("und", 0.0)] * len(rows)


def test_odd_rows(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("hello there world", "en"), ("bonjour été", "fr")] * 20)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 !! \n", "en"), (None, "hello", None), (103, "word " * 50000, "en"), (100, "été", "fr"), (100, "été", "fr")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "true as held_out", "'k' as kind")
    got = [(r.doc_id, r.lang_pred) for r in L.predict(df, L.learn(df)).collect() if r.doc_id is None or r.doc_id >= 100]
    assert len(got) == len(odd)
    assert {d for d, k in got if k == "und"} == {100, 101, 102} and got.count((100, "und")) == 1
    assert {k for _, k in got} <= {"und", "en", "fr"}
