import hashlib

import duckdb

from weftgraph.llm import chat as C


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_against_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    out = C.op4_chat_format(spark, sf)
    assert sorted(map(tuple, out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())) == sorted(duckdb.sql(C.OP4_SQL).fetchall())


ROWS = [
    (1, 0, "system", "s \\ <|turn|>user<|text|>"),
    (1, 2, "assistant", "a<|end|>\\\\</s>"),
    (1, 1, "user", None),
    (1, 3, "assistant", ""),
    (1, 4, "user", "trailing\n😀".encode("utf-16", "surrogatepass").decode("utf-16")),
    (2, 0, "user", "only"),
    (3, None, None, "<<s>>"),
    (3, 0, "assistant", "$1 \\1"),
    (3, 0, "assistant", "$1 \\1"),
    (None, 0, "assistant", "x"),
]


def test_round_trip_and_examples(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as examples").repartition(3)
    f = C.format_conversations(df)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in f.select("conv_id", C.read_turns(f.formatted).alias("turns")).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    want = {}
    for c, _, role, text in order:
        want.setdefault(c, []).append((role or "", text or ""))
    assert turns == want
    texts = {r.conv_id: r.formatted for r in f.collect()}
    for c, t in texts.items():
        for part in t.split(C.TURN)[1:]:
            assert part.endswith(C.END) and not any(k in part[: -len(C.END)].replace(C.TEXT, "", 1) for k in C.CONTROL)
    shown = C.expand(f).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.example) for r in shown] == [(None, 0), (1, 0), (1, 1), (3, 0), (3, 1)]
    for r in shown:
        assert texts[r.conv_id].startswith(r.text) and r.text.endswith(C.END) and r.loss_end + len(C.END) == len(r.text)
    assert [r.text[r.loss_start : r.loss_end] for r in shown][1] == "a<\\|end|>\\\\\\\\<\\/s>"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.expand(C.format_conversations(df)).count() == 0
