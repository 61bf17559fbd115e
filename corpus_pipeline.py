"""From documents to token ids: five of the operators of weftgraph.llm, one after the other.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents:

toxicity       documents scored 0.7 or more go
near_dedup     of each group of near copies the document with the smallest id stays
substring      words in 50-word windows that a smaller document has too are cut out of text
decontaminate  documents that hold a benchmark passage go
tokens         byte-level BPE: ids, their number and hash, and the hash of the bytes they decode to

Defined results: a null or empty text scores the model's bias, resembles nothing, has no words and no tokens, and is
kept; rows with one doc_id are judged together; rows without one are kept by near_dedup and substring, and judged
by their own text in toxicity and decontaminate; of
repeated rows all are kept or none; ties go to the smaller id; empty tables give an empty result; a very long
text is one row like any other; further columns, whatever their names, go through untouched up to the last stage.

No SQL is given: a trained classifier and a tokenizer's merges are beyond it; tests hold run() against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontaminate, minhash, substring_dedup, toxicity
from weftgraph.llm.common import place, release, stored_at, table, taken

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_only(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_groups(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring", cut_repeats),
    ("decontaminate", drop_leaks),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path, before = place(spark, f"pipeline-{name}"), taken()
        docs = stored_at(stage(spark, docs, sf_dir), path)
        release(before)  # what the stage itself stored
    return STAGES[-1][1](spark, docs, sf_dir)
