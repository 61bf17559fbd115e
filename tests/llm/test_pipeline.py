import hashlib

import corpus_pipeline as P
import public_tokenizers
import tiktoken

from weftgraph.llm import bpe, toxicity

from . import brute
from .test_decontaminate import normal


def test_stages_have_documents_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_dedup", "substring", "decontaminate", "tokens"]
    for _, f in P.STAGES[:-1]:
        out = f(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0
    assert P.tokens(spark, docs.limit(0), sf).count() == 0


def test_run_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    kept = {d for d, _, _, k in brute.near(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Coder(bpe.rank_file()).ranks, special_tokens={})
    cut = {d: (n, h) for d, _, n, h in brute.substring(rows)}
    got = {r.doc_id: r for r in P.run(spark, sf).collect()}
    texts = {}
    for d, t in rows:
        if not cut[d][0]:
            texts[d] = t
    assert set(got) == {d for d in kept if d in got} and len(got) <= len(rows)
    for d, t in texts.items():
        leaks = any(i in normal(t) for i in items)
        assert not (leaks and d in got)
        if d in got:
            ids = enc.encode_ordinary(t)
            assert got[d].ids == ids and got[d].n_tokens == len(ids)
            assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for d in set(cut) - set(texts):
        if d in got:
            assert got[d].decoded_sha256 == cut[d][1]
    assert sum(not any(i in normal(t) for i in items) and d not in got for d, t in texts.items()) == 0


def test_odd_rows_pass(spark, sf):
    text = " ".join(f"w{i % 61}" for i in range(90))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", "s", 9), (3, text, None, "s", 9), (3, text, None, "s", 9), (4, text + " more", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in P.STAGES:
        docs = f(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "3", "None"]


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    names = ["tag", "spans", "rest", "a", "group", "bucket", "kept", "score", "toxic", "key", "n_words", "component_id", "item_id"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(i, f"some words of text {i}", None, None, 20, *range(len(names))) for i in range(4)], kind)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, docs.limit(0)):
        want = sorted(map(tuple, rows.collect()))
        for _, f in P.STAGES[:-1]:
            out = f(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and sorted(map(tuple, out.collect())) == want
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
