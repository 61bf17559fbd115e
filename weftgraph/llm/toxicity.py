"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

Channel: a writer may replace letters (leetspeak), repeat them, or put separators or spaces between
them. A token or run of short pieces that shows any of it becomes a lattice, whatever its length and whether
or not it has a letter: each character is read as itself, as a letter it may stand for, as a repeat of the
letter before, or as nothing; a separator or space also as the end of a word. Marks that stand for letters
belong to the lattice at a token's end too, where it weighs them against punctuation. Viterbi finds the
likeliest words under a character trigram model times the channel's probabilities. Plain tokens are their own
restoration; of others only what is restored is scored.

Score: logistic regression over the presence of restored words and of their beginnings.

Learning uses labelled rows whose crc32(doc_id) mod 3 is not 1: the character model counts the trigrams of
all their words; the features and their weights come from a sample of at most SAMPLE of either label (those
whose ids hash lowest). What the driver gets is bounded by the alphabet's trigrams and SAMPLE: a feature
stands in LEAST_SHARE of the toxic sample at least.
Nothing but text enters a score.

Defined results: null and empty texts score the model's bias; without labelled rows of both kinds every
score is 0; repeated rows score alike; a label outside 0 and 1 is no label; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, held, stored, table

#: Documents of either label that the regression learns from.
SAMPLE = 3000
THRESHOLD = 0.7
#: A feature is in this share of the toxic sample at least, and RATIO times as common as in the other.
LEAST_SHARE, RATIO = 0.004, 8.0
#: Restorations that a worker keeps; words, and trigrams, that it counts before it hands their counts on.
KEEP = 200_000
#: What a character may stand for, beside itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = set(".-_*~'`^:/\\,;#+=&%​­")
#: Logarithms of the channel's probabilities.
KEPT, SUBSTITUTED, SEPARATED, REPEATED, DOUBLED = math.log(0.9), math.log(0.08), math.log(0.05), math.log(0.02), math.log(0.001)
#: A mark at a token's end or beginning is punctuation: exclamation marks and brackets mostly, others that stand
#: for letters seldom.
EXCLAIMED, DROPPED = math.log(0.5), math.log(0.004)
#: A token without any letter is the number or sign that it is, unless it reads likelier as words.
NUMERAL = -13.0
EDGE = "\x02"

# no character is both letter and separator here, so a long run is read once
_spaced = re.compile(r"(?<!\S)(?:[^\s.\-_*]{1,2}[ .\-_*]{1,3}){2,}[^\s.\-_*]{1,2}(?![^\s.,;:!?])")
# plain letters of which no two alike are neighbours have one reading: themselves; all else is decoded
_suspicious = re.compile(r"[\W\d_]|(.)\1")
# no word has five equal letters in a row: more of them say no more than four
_stretched = re.compile(r"([^\W_])(?:[ .\-_*]*\1){4,}")
_word = re.compile(r"[^\W_]+")
# a letter alone is a word only if nothing touches it: i.d.i.o.t has none
_plain = re.compile(r"(?<![^\W_])[^\W\d_]{2,}(?![^\W_])|(?<!\S)[^\W\d_](?!\S)")
# what no reading uses: the lattice decides about the rest
_trailing = "".join((SEPARATORS | set("?)[]{}<>\"")) - LEET.keys())


def trigrams(words: dict[str, int]) -> Counter:
    three = Counter()
    for w, n in words.items():
        w = EDGE + EDGE + w + EDGE
        for i in range(2, len(w)):
            three[w[i - 2 : i + 1]] += n
    return three


class CharModel:
    """Trigrams of letters, smoothed; Viterbi over the lattices of obfuscated tokens."""

    def __init__(self, words: dict[str, int]):
        self._fit(trigrams(words))

    @classmethod
    def of_trigrams(cls, three: dict[str, int]) -> CharModel:
        model = cls.__new__(cls)
        model._fit(three)
        return model

    def _fit(self, three: dict[str, int]) -> None:
        self.letters = {k[2] for k in three if k[2] != EDGE}
        two = Counter()
        for k, n in three.items():
            two[k[:2]] += n
        some = len(self.letters) + 1
        self.log = {k: math.log((n + 0.01) / (two[k[:2]] + 0.01 * some)) for k, n in three.items()}
        self.new = {k: math.log(0.01 / (n + 0.01 * some)) for k, n in two.items()}
        self.unseen = math.log(1 / some)

    def _step(self, context: str, c: str) -> float:
        got = self.log.get(context + c)
        return got if got is not None else self.new.get(context, self.unseen)

    def restore(self, token: str) -> str:
        """The likeliest words behind a token or run (in lower case), with a space between them."""
        token = _stretched.sub(r"\1\1\1\1", token)
        # a path is a chain of (what came before, letter): the few contexts share their beginnings
        best: dict[str, tuple[float, tuple | None]] = {EDGE + EDGE: (0.0, None)}
        marks = lambda chars: sum(1 for _ in itertools.takewhile(lambda c: not c.isalnum(), chars))
        begin, end = marks(token), len(token) - marks(reversed(token))
        for k, c in enumerate(token):
            new: dict[str, tuple[float, tuple | None]] = {}
            own = c.isalpha()
            reads = ([(c, KEPT)] if own else []) + [(x, SUBSTITUTED) for x in LEET.get(c, "")]
            many = token[max(0, k - 2) : k + 3].count(c) >= 3  # two alike are mostly meant
            for context, (score, path) in best.items():
                moves = [(context[1] + r, score + p + self._step(context, r), (path, r)) for r, p in reads]
                if c in SEPARATORS or c == " ":
                    moves.append((context, score + SEPARATED, path))
                    if context[1] != EDGE and k < len(token) - 1:  # the trigrams say how likely a word ends here
                        moves.append((EDGE + EDGE, score + SEPARATED + self._step(context, EDGE), (path, " ")))
                elif not reads:
                    moves.append((context, score + SEPARATED + SUBSTITUTED, path))
                elif k >= end or k < begin:
                    moves.append((context, score + (EXCLAIMED if c in "!¡(" else DROPPED), path))
                for r, p in reads:
                    if r == context[1]:
                        moves.append((context, score + p + (REPEATED if many else DOUBLED), path))
                for key, s, t in moves:
                    if key not in new or s > new[key][0]:
                        new[key] = (s, t)
            best = new
        score, last = max((s + self._step(k, EDGE), k) for k, (s, _) in best.items())
        if score <= NUMERAL and not any(map(str.isalpha, token)):
            return token
        path, letters = best[last][1], []
        while path is not None:
            path, r = path
            letters.append(r)
        return "".join(reversed(letters)).strip()


def beginnings(word: str) -> list[str]:
    return [word] + [f"{word[:n]}~" for n in (4, 5) if len(word) >= n]


def _hides(bare: str) -> bool:
    """Whether a token without its trailing punctuation may read otherwise than it stands."""
    return _suspicious.search(bare) is not None


def restored(token: str, model: CharModel) -> list[str]:
    """The words a token (no spaces in it, lower case) stands for: as it reads or, where it may hide others, restored."""
    bare = token.rstrip(_trailing)
    return model.restore(bare).split() if _hides(bare) else _word.findall(bare)


def restore_text(text: str, model: CharModel) -> str:
    """A text with its suspicious tokens and spaced-out words replaced by what they stand for."""
    low = (text or "").lower()
    low = _spaced.sub(lambda m: model.restore(m[0]), low)

    def meant(m: re.Match) -> str:
        bare = m[0].rstrip(_trailing)
        got = model.restore(bare) if _hides(bare) else bare
        return m[0] if got in (bare, re.sub(r"\W+\Z", "", bare)) else got

    return re.sub(r"\S+", meant, low)


class Features:
    """Words and beginnings of a text, looked up in a numbering; tokens are kept."""

    def __init__(self, model: CharModel, number: dict[str, int] | None):
        self.model, self.number, self.kept = model, number, {}

    def of_token(self, token: str) -> tuple:
        got = self.kept.get(token)
        if got is None:
            got = tuple(f for w in restored(token.lower(), self.model) for f in beginnings(w))
            if self.number is not None:
                got = tuple(self.number[f] for f in got if f in self.number)
            if len(self.kept) >= KEEP:
                self.kept.clear()
            if len(token) <= 60:
                self.kept[token] = got
        return got

    def of_text(self, text: str) -> set:
        out: set = set()
        for t in set(text.split()):
            if got := self.of_token(t):
                out.update(got)
        for run in {m[0] for m in _spaced.finditer(text)}:
            out.update(self.of_token(run))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the documents to learn from."""
    own = allowed(labels)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = own.where("toxic = 1").orderBy(*order).limit(SAMPLE).union(own.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # copies and near copies would pass their chance words off as signs: of the documents that share the
    # least hash of their 3-word windows, one is kept
    words = F.filter(F.split(F.lower("text"), SPACES), lambda w: w != "")
    texts = texts.withColumn("words", words).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("hashes") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("hashes", F.lit(1), n), F.slice("hashes", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(pairs, F.slice("hashes", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    like = F.coalesce(F.array_min(three), F.xxhash64("text"))
    first = texts.groupBy(like.alias("like"), "toxic").agg(F.min_by("text", "doc_id").alias("text"))
    return first.select("text", "toxic")


def allowed(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled rows that may be learnt from."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): letter trigrams of the batches' words, each word once a text."""
    words, three = Counter(), Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(three), pa.string()), pa.array(list(three.values()), pa.int64())], ["gram", "n"])
        three.clear()
        return rows

    for b in batches:
        for text in b.column("text"):
            words.update(set(_plain.findall(_spaced.sub(" ", (text.as_py() or "").lower()))))
            if len(words) >= KEEP:
                three.update(trigrams(words))
                words.clear()
            if len(three) >= KEEP:
                yield out()
    three.update(trigrams(words))
    yield out()


def char_model(docs: DataFrame, labels: DataFrame) -> CharModel:
    """From all texts that may be learnt from; a merge join, so that disk grows with the input."""
    own = docs.select("doc_id", "text").where("doc_id is not null and text is not null").where(~held_out())
    own = own.join(allowed(labels).select("doc_id").hint("merge"), "doc_id", "left_semi").select("text")
    rows = own.mapInArrow(_letters, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # the alphabet bounds them
    return CharModel.of_trigrams({r.gram: r.n for r in rows})


def _counted(feature_of):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, toxic = [], []
            for text, kind in zip(b.column("text"), b.column("toxic")):
                got = feature_of(text.as_py())
                names += got
                toxic += [kind.as_py()] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["name", "toxic"])

    return go


class Model:
    def __init__(self, chars: CharModel, names: list[str], weights: np.ndarray, bias: float):
        self.chars, self.names, self.weights, self.bias = chars, names, weights, bias
        self.features = Features(chars, {n: i for i, n in enumerate(names)})

    def score(self, text: str | None) -> float:
        x = self.bias + sum(self.weights[i] for i in self.features.of_text(text or ""))
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, x)))))


def fit_weights(rows: list[list[int]], toxic: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty, by gradient descent with momentum; classes weigh alike."""
    x = np.zeros((len(rows), n + 1))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, n] = 1
    share = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    w, v = np.zeros(n + 1), np.zeros(n + 1)
    for _ in range(1500):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ ((p - toxic) * share) + 2e-5 * np.append(w[:n], 0)
        v = 0.9 * v - 2.0 * g
        w = w + v
    return w[:n], float(w[n])


def shift(rows: list[list[int]], toxic: np.ndarray, weights: np.ndarray, bias: float) -> float:
    """What to add to the bias so that THRESHOLD lies between the labels, nearer to the clean; 0 where they
    overlap. A penalised fit wants several signs of a document, even if one never occurs in clean ones."""
    z = np.array([bias + weights[r].sum() for r in rows])
    low, high = np.quantile(z[toxic == 0], 0.998), np.quantile(z[toxic == 1], 0.02)
    return float(math.log(THRESHOLD / (1 - THRESHOLD)) - (low + 0.3 * (high - low))) if high > low + 1 else 0.0


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    texts = stored(sample(docs, labels), "toxicity-sample")
    chars = char_model(docs, labels)
    size = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model(chars, [], np.zeros(0), -40.0)

    def named(t: str) -> list[str]:
        return list(Features(chars, None).of_text(t))

    found = texts.mapInArrow(_counted(named), "name string, toxic int").groupBy("name").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    share = (F.col("t") + 0.5) / size[1] / ((F.col("n") - F.col("t") + 0.5) / size[0])
    found = found.where(F.col("t") >= max(3, math.ceil(LEAST_SHARE * size[1]))).where(share >= RATIO)
    names = sorted(r.name for r in found.collect())
    number = {n: i for i, n in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(chars, number)
        for b in batches:
            rows = [sorted(f.of_text(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "on"])

    rows = sorted((r.toxic, r.on) for r in texts.mapInArrow(numbered, "toxic int, on array<int>").collect())  # 2 * SAMPLE rows at most
    toxic = np.array([r[0] for r in rows])
    weights, bias = fit_weights([r[1] for r in rows], toxic, len(names))
    return Model(chars, names, weights, bias + shift([r[1] for r in rows], toxic, weights, bias))



def _model(state: tuple) -> Model:
    """One model a worker, which keeps its tokens from task to task."""
    return held(("toxicity", hash((tuple(state[1]), state[2].tobytes(), state[3]))), lambda: Model(*state))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    state = (model.chars, model.names, model.weights, model.bias)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared.value)
        for b in batches:
            got = [own.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    out = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(go, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_only(docs: DataFrame, model: Model) -> DataFrame:
    """docs that the model doesn't call toxic, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.chars, model.names, model.weights, model.bias))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared.value)
        for b in batches:
            yield b.filter(pa.array([own.score(t.as_py()) < THRESHOLD for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(go, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels")))
