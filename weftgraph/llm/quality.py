"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials are counted over all
documents: the raw corpus, and the trusted target, which is all documents that labels call good. A
document's score is the mean, over its n-grams, of log(target / raw); below THRESHOLD it is rejected. The
buckets are the same number however large the corpus, so the weights (BUCKETS doubles) go to the tasks as
a literal. The good ids grow with the corpus and are joined as any other table.

n_repeat_words: 3-word windows are compared by 64-bit hashes, sorted with their places inside the row;
nothing leaves the row, whatever its length.

Defined results: null text has no words and fails the base rules; a text of one word has one n-gram;
without trusted documents every score is 0; rows are judged one by one, so repeated rows and null ids
count as they come; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table

BUCKETS = 1 << 16
THRESHOLD = -0.25
SMOOTHING = 1.0
#: Base rules: words a document needs, and the percentage of words in repeated windows that it may have.
LEAST_WORDS, MOST_REPEATED = 50, 50
_INDEX_BITS = 16


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def n_grams(docs: DataFrame, *more: str) -> DataFrame:
    """docs' doc_id, text and columns of more with words, h1 (hashes of words) and h2 (of pairs)."""
    words = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
    words = words.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    hashed = words.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    pairs = F.greatest(F.size("h1") - 1, F.lit(0))
    return hashed.withColumn("h2", F.zip_with(F.slice("h1", F.lit(1), pairs), F.slice("h1", F.lit(2), pairs), lambda a, b: F.xxhash64(a, b)))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of every bucket."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(1))
    # before the n-grams, which are many times the text; always a merge join, so that disk grows with the input
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    grams = n_grams(marked, "good").select("good", F.explode(F.transform(F.concat("h1", "h2"), _bucket)).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")).collect()  # BUCKETS rows at most
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    n, m = sum(raw), sum(target)
    if not m:
        return [0.0] * BUCKETS
    base = math.log((n + SMOOTHING * BUCKETS) / (m + SMOOTHING * BUCKETS))
    return [math.log((t + SMOOTHING) / (r + SMOOTHING)) + base for t, r in zip(target, raw)]


def base_counts(grams: DataFrame) -> DataFrame:
    """n_grams' rows with the base rules' counts."""
    text = F.col("text")
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    three = F.greatest(F.size("h1") - 2, F.lit(0))
    df = grams.withColumn("h3", F.zip_with(F.slice("h2", F.lit(1), three), F.slice("h1", F.lit(3), three), lambda a, b: F.xxhash64(a, b)))
    few = F.size("h3") < (1 << _INDEX_BITS)
    low = (1 << _INDEX_BITS) - 1
    # hash and place in one long, for a primitive sort; a text of more windows sorts pairs
    df = df.withColumn("packed", F.when(few, F.sort_array(F.transform("h3", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    alike = lambda x, y: (F.shiftright(x, _INDEX_BITS) == F.shiftright(y, _INDEX_BITS)) & (F.get("h3", at(x)) == F.get("h3", at(y)))
    short = F.transform(F.filter("packed", lambda x, i: alike(x, F.get("packed", i + 1)) | alike(x, F.get("packed", i - 1))), at)
    pairs = F.sort_array(F.transform("h3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    long = _let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: (x.h == F.get(s, i + 1).h) | (x.h == F.get(s, i - 1).h)), lambda x: x.i))
    df = df.withColumn("places", F.sort_array(F.when(few, short).otherwise(long)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("places", start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a.n)
    return df.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]"[1:-1]).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, llr and kept."""
    # one literal, folded once by the optimiser
    table = F.split(F.lit(",".join(map(repr, weights(docs, labels)))), ",").cast("array<double>")
    df = base_counts(n_grams(docs))
    grams = F.concat("h1", "h2")
    total = F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.get(table, _bucket(h)))
    df = df.withColumn("llr", F.when(F.size("h1") > 0, total / (F.size("h1") + F.size("h2"))).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr", (~failed & (F.col("llr") >= THRESHOLD)).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
