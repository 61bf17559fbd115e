import hashlib
import random

import public_tokenizers as P
import tiktoken

from weftgraph.llm import bpe as B


def coders():
    own = B.Coder(B.rank_file())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_as_the_library(spark, sf):
    _, enc = coders()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in B.op3_byte_bpe(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_random_texts():
    own, enc = coders()
    rnd = random.Random(2)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "\t", "é", "ß", "1", "22", "!", "...", "'s", "'ll", "\x1c", "\x85", "\xa0", "日本", "😀", "​", "<|endoftext|>", "A", "́"]
    for _ in range(400):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        ids = own.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_very_long_pretokens():
    own, enc = coders()
    rnd = random.Random(4)
    for t in ("a" * 20000, "".join(rnd.choice("abcdeth") for _ in range(20000)), "=" * 5001, " " * 3000 + "x"):
        assert own.encode(t) == enc.encode_ordinary(t)
    big = "".join(rnd.choice("etaoin shrdlu") for _ in range(B.STEP * 5))
    n, names, back = own.digest(big)
    ids = enc.encode_ordinary(big)
    assert (n, names, back) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(big.encode()).hexdigest())


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 5, None), (2, "", 6, "r"), (2, "ab cd", 7, "s")], "doc_id long, text string, ids int, rest string")
    out = B.decode_documents(B.encode_documents(df))
    got = sorted([(r.text or "", bytes(r.decoded), len(r.ids), r.rest) for r in out.collect()], key=str)
    assert got == sorted([("", b"", 0, None), ("", b"", 0, "r"), ("ab cd", b"ab cd", 2, "s")], key=str)
    assert out.columns == ["doc_id", "text", "rest", "ids", "decoded"]
    assert B.digests(df.limit(0)).count() == 0
