import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import toxicity as T


@pytest.fixture(scope="module")
def chars():
    words = dict.fromkeys(["idiot", "stupid", "moron", "pathetic", "worthless", "trash", "the", "there", "their", "people", "hello", "letter", "common", "process", "still"], 50)
    return T.CharModel(words)


@pytest.mark.parametrize("seen,meant", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiiiiot", "idiot"), ("$tup1d!!", "stupid"), ("m0r0n", "moron"), ("p@th3tic", "pathetic"), ("w0rthl3ss", "worthless"), ("t-r-a-s-h", "trash"), ("tr@@@sh", "trash"), ("st1ll", "still")])
def test_restores(chars, seen, meant):
    assert T.restore_text(seen.upper(), chars).rstrip("!") == meant


def test_plain_text_is_its_own_restoration(chars):
    t = "hello there, people!! letter *** ### 12 3.5 common."
    assert T.restore_text(t, chars) == t


def test_viterbi_is_the_best_of_all_readings(chars):
    rnd = random.Random(1)

    def readings(token):
        """(score, text) of every path, by recursion."""
        begin, end = len(token) - len(token.lstrip(".$")), len(token.rstrip(".$"))

        def go(k, context, score, text):
            if k == len(token):
                yield score + chars._step(context, T.EDGE), text
                return
            c = token[k]
            reads = ([(c, T.KEPT)] if c.isalpha() else []) + [(x, T.SUBSTITUTED) for x in T.LEET.get(c, "")]
            many = token[max(0, k - 2) : k + 3].count(c) >= 3
            for r, p in reads:
                yield from go(k + 1, context[1] + r, score + p + chars._step(context, r), text + r)
                if r == context[1]:
                    yield from go(k + 1, context, score + p + (T.REPEATED if many else T.DOUBLED), text)
            if c in T.SEPARATORS or c == " ":
                yield from go(k + 1, context, score + T.SEPARATED, text)
            elif not reads:
                yield from go(k + 1, context, score + T.SEPARATED + T.SUBSTITUTED, text)
            elif k >= end or k < begin:
                yield from go(k + 1, context, score + T.DROPPED, text)

        if not any(c.isalpha() for c in token) and max(go(0, T.EDGE + T.EDGE, 0.0, ""))[0] <= T.NUMERAL:
            return 0.0, token
        return max(go(0, T.EDGE + T.EDGE, 0.0, ""))

    for _ in range(60):
        token = "".join(rnd.choice("tthhe1i0o.s$m") for _ in range(rnd.randrange(1, 8)))
        best = readings(token)
        got = chars.restore(token)
        assert got == best[1] or abs(best[0] - max(s for s, t in [readings(token)])) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = T.op7_toxicity(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted", "score", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert sum(r.toxic == r.predicted for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def data(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        w = [rnd.choice(["ala", "bolo", "cantar", "dedo"]) + rnd.choice(["ra", "mi", "ton"]) for _ in range(30)]
        if i % 3 == 0:
            w[5], w[9] = rnd.choice(["idiot", "moron", "trash"]), rnd.choice(["idiot", "moron", "trash"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def test_planted_and_odd_rows(spark):
    rows, labels = data(spark)
    odd = [(900, "alara dedo M0R0N bolo 1d1ot"), (901, "alara i d i o t and t.r.a.s.h"), (902, None), (903, ""), (904, "dedo mi " * 30000), (None, "moron idiot"), (900, "alara dedo M0R0N bolo 1d1ot")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as toxic", "0.5 as score", "'x' as held_out").repartition(3)
    lab = spark.createDataFrame(labels + [(1, 5), (None, 1), (2, None), (77777, 1)], "doc_id long, toxic int")
    model = T.learn(df, lab)
    got = T.scores(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[i] == t for i, t in labels)
    assert by[900] == by[901] == by[None] == 1 and by[902] == by[903] == by[904] == 0
    kept = T.clean_only(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, p in by.items() if not p}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "moron"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for l in (lab, lab.limit(0)):
        assert [r.score < 1e-9 for r in T.scores(df, T.learn(df, l)).collect()] == [True, True]
    assert T.scores(df.where(F.lit(False)), T.learn(df, lab)).count() == 0


RUNS = {
    "s t u p i d i d i o t": "stupid idiot",
    "s t u p i d  m o r o n": "stupid moron",
    "s.t.u.p.i.d.i.d.i.o.t": "stupid idiot",
    "w o r t h l e s s p e o p l e p a t h e t i c p r o c e s s s t u p i d t r a s h i d i o t": "worthless people pathetic process stupid trash idiot",
    "i d " + "i " * 60 + "o t": "idiot",
    "i" * 60 + "d10t": "idiot",
    "m-o-r-o-n" + "-" * 50 + "s": "moron s",
}


@pytest.mark.parametrize("seen", RUNS)
def test_runs_of_any_length_are_words(chars, seen):
    f = T.Features(chars, None).of_text(seen.upper())
    assert {w for w in RUNS[seen].split() if len(w) > 1} <= f


def test_run_after_a_word_and_short_run(chars):
    model = T.CharModel(dict.fromkeys(["such", "a", "moron", "ass", "the"], 50))
    assert "moron" in T.Features(model, None).of_text("such a m o r o n")
    assert "ass" in T.Features(model, None).of_text("the a s s")


def test_a_long_document_letter_by_letter(chars):
    text = " ".join("thepeople" * 10_000 + "idiot" + "hello" * 10_000)
    assert "idiot" in T.Features(chars, None).of_text(text)


@pytest.mark.parametrize("seen,meant", [("stuupid", "stupid"), ("iddiioott", "idiot"), ("Moorron,", "moron"), ("idio7", "idiot"), ("hello", "hello"), ("common", "common")])
def test_doubled_letters_are_decoded(chars, seen, meant):
    assert meant in T.Features(chars, None).of_text(seen)
    assert T.restore_text(seen, chars).rstrip(",") == meant


def test_the_character_model_counts_all_allowed_rows(spark):
    rows = [(i, f"alara q{'xyz'[i % 3]}zz i d i o t m.o.r.o.n 1d1ot " + "w" * 40) for i in range(9000)] + [(9001, "unlabelled"), (None, "nobody")]
    labels = [(i, i % 2) for i in range(9000)] + [(None, 1), (3, 7)]
    own = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = T.trigrams({"alara": len(own), "w" * 40: len(own)})
    for i in own:
        want.update(T.trigrams({f"q{'xyz'[i % 3]}zz": 1}))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = T.char_model(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    whole = T.CharModel.of_trigrams(want)
    assert len(own) > 5500 and (got.log, got.new, got.unseen) == (whole.log, whole.new, whole.unseen)


@pytest.mark.parametrize("seen", ["a$$", "@$$", "455", "a55", "A$$!!", "a s s"])
def test_marks_at_the_end_and_tokens_without_letters(seen):
    model = T.CharModel(dict.fromkeys(["pass", "class", "ass", "a", "as", "the", "cost", "has"], 50))
    assert "ass" in T.Features(model, None).of_text(f"the {seen} cost")


@pytest.mark.parametrize("seen,meant", [("pa$$", "pass"), ("cla$$", "class"), ("bull$h!t", "bullshit"), ("id io t", "idiot"), ("12 cost!", "cost"), ("cost (the)", "the")])
def test_words_that_end_in_marks(seen, meant):
    model = T.CharModel(dict.fromkeys(["pass", "class", "bullshit", "idiot", "a", "the", "cost", "has", "it"], 50))
    assert meant in T.Features(model, None).of_text(seen)


def test_chance_pieces_are_not_scored():
    model = T.CharModel(dict.fromkeys(["bullshit", "bull", "the"], 50))
    assert not {"bull", "h", "t"} & T.Features(model, None).of_text("bull$h!t")
    assert T.restore_text("455 1200 $5", T.CharModel(dict.fromkeys(["the", "people"], 50))) == "455 1200 $5"
