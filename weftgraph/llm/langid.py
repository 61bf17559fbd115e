"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read as UTF-8 bytes, spaces and all, in windows of SPAN bytes that overlap: the network sees MARGIN
bytes more on either side, as far as the text goes, so its state crosses words and each position is labelled
with at least that much of its surroundings. A document's probabilities are the mean over all its positions;
whole texts are pooled, no prefixes.

Training: backpropagation through time over stretches of TRAIN bytes of a sample of at most SAMPLE documents
a language (those whose ids hash lowest), from rows whose crc32(doc_id) mod 4 is not 2 and whose lang isn't
null; at most STRETCHES a language reach the driver, so its memory doesn't grow with the corpus.

Defined results: null text and text without a letter are ``und`` with score 0; letters outside the
training languages get some learned label; without training rows all are ``und``; a text of any length is read
a few windows at a time; repeated rows each get their answer; other columns are ignored; ties go to the label
first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_slices

SAMPLE, STRETCHES, TRAIN = 600, 1500, 64
SPAN, MARGIN = 224, 16
#: Windows read at once; their lengths are rounded up to STEP.
READ, STEP = 1024, 16
DIM, HIDDEN = 8, 8
EPOCHS, BATCH, RATE = 4, 64, 1e-2
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs over bytes and a linear label for every position. Input is a byte plus 1; 0 stands outside the
    text and puts the state to 0, where it begins."""

    NAMES = ("emb", "wf", "uf", "bf", "wb", "ub", "bb", "out", "ob")

    def __init__(self, labels: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.emb = init(257, DIM) * 4
        for d in "fb":
            setattr(self, "w" + d, init(DIM, 3 * HIDDEN))
            setattr(self, "u" + d, init(HIDDEN, 3 * HIDDEN))
            setattr(self, "b" + d, np.zeros(3 * HIDDEN, np.float32))
        self.out, self.ob = init(2 * HIDDEN, labels), np.zeros(labels, np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    @classmethod
    def of(cls, weights: list[np.ndarray]) -> Network:
        net = cls.__new__(cls)
        for n, w in zip(cls.NAMES, weights):
            setattr(net, n, w)
        return net

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States (T, N, H) of one direction over inputs x (T, N), none of them 0."""
        w, u, b = getattr(self, "w" + d), getattr(self, "u" + d), getattr(self, "b" + d)
        table = self.emb @ w + b
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, saved = np.empty((*x.shape, HIDDEN), np.float32), {}
        H = HIDDEN
        for t in steps:
            a = table[x[t]]
            g = h @ u
            z, r = _sigmoid(a[:, :H] + g[:, :H]), _sigmoid(a[:, H : 2 * H] + g[:, H : 2 * H])
            c = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
            if keep:
                saved[t] = (h, z, r, c, g[:, 2 * H :])
            h = c + z * (h - c)
            states[t] = h
        return states, saved

    def probabilities(self, x: np.ndarray, keep: bool = False):
        """P(label) at every position: (T, N, labels)."""
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        h = np.concatenate([f, b], axis=2)
        y = h @ self.out + self.ob
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        return (y, h, sf, sb) if keep else y

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over positions, by backpropagation through time."""
        y, h, sf, sb = self.probabilities(x, True)
        T, N = x.shape
        dy = y.copy()
        dy[:, np.arange(N), labels] -= 1
        dy /= T * N
        grad = {n: np.zeros_like(w) for n, w in zip(self.NAMES, self.weights)}
        grad["out"] = h.reshape(T * N, -1).T @ dy.reshape(T * N, -1)
        grad["ob"] = dy.sum((0, 1))
        dh = dy @ self.out.T
        H = HIDDEN
        for d, part, saved in (("f", dh[:, :, :H], sf), ("b", dh[:, :, H:], sb)):
            u, w = getattr(self, "u" + d), getattr(self, "w" + d)
            carry = np.zeros((N, H), np.float32)
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                old, z, r, c, gc = saved[t]
                dn = part[t] + carry
                dz = dn * (old - c) * z * (1 - z)
                dc = dn * (1 - z) * (1 - c * c)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                da = np.concatenate([dz, dr, dc], axis=1)
                grad["u" + d] += old.T @ dg
                grad["b" + d] += da.sum(0)
                e = self.emb[x[t]]
                grad["w" + d] += e.T @ da
                np.add.at(grad["emb"], x[t], da @ w.T)
                carry = dn * z + dg @ u.T
        return [grad[n] for n in self.NAMES]


    def _gates(self, d: str) -> tuple[np.ndarray, np.ndarray]:
        """What each input adds to the gates (3H, 257), halved for the sigmoids' tanh, and the state's part (3H, H)."""
        scale = np.repeat(np.array([0.5, 1], np.float32), [2 * HIDDEN, HIDDEN])[:, None]
        adds = (self.emb @ getattr(self, "w" + d) + getattr(self, "b" + d)).T * scale
        adds[:, 0] = np.repeat(np.array([-30, 0], np.float32), [2 * HIDDEN, HIDDEN])
        return np.ascontiguousarray(adds), np.ascontiguousarray(getattr(self, "u" + d).T * scale)

    def sums(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Per column of x (T, N): the sum of P(label) over its positions lo to hi - 1, as (N, labels).
        One state after the other; columns side by side, so that each step works on long rows."""
        T, N, H = len(x), x.shape[1], HIDDEN
        total, back = np.zeros((len(self.ob), N), np.float32), np.empty((T, H, N), np.float32)
        out = np.ascontiguousarray(self.out.T)
        a, g = np.empty((3 * H, N), np.float32), np.empty((3 * H, N), np.float32)
        for d in "bf":
            adds, u = self._gates(d)
            h = np.zeros((H, N), np.float32)
            for t in range(T - 1, -1, -1) if d == "b" else range(T):
                np.take(adds, x[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=g)
                zr = a[: 2 * H]
                zr += g[: 2 * H]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = g[2 * H :]
                c *= zr[H:]
                c += a[2 * H :]
                np.tanh(c, out=c)
                h -= c
                h *= zr[:H]
                h += c
                if d == "b":
                    back[t] = h
                    continue
                y = out[:, :H] @ h
                y += out[:, H:] @ back[t]
                y += self.ob[:, None]
                y -= y.max(axis=0)
                np.exp(y, out=y)
                y *= ((lo <= t) & (t < hi)) / y.sum(axis=0)
                total += y
        return total.T


def symbols(parts: list[bytes]) -> np.ndarray:
    """Stretches of one length as network input (T, N)."""
    return np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), -1).T.astype(np.int64) + 1


def train(parts: list[bytes], labels: np.ndarray, kinds: int, seed: int = 1) -> Network:
    """Adam over batches of stretches of one length."""
    net, rng = Network(kinds, seed), np.random.default_rng(seed)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(parts):
        by.setdefault(len(w), []).append(i)
    m, v, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    for epoch in range(EPOCHS):
        batches = []
        for own in by.values():
            own = rng.permutation(own)
            batches += [own[i : i + BATCH] for i in range(0, len(own), BATCH)]
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
        for k in rng.permutation(len(batches)):
            some, step = batches[k], step + 1
            grads = net.gradients(symbols([parts[i] for i in some]), labels[some])
            for w, g, a, b in zip(net.weights, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def pooled(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """P(label) of each document, 0 for those without bytes."""
    sizes = np.diff(offs)
    n = -(-sizes // SPAN)
    doc = np.repeat(np.arange(len(sizes)), n)
    core = offs[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * SPAN
    end = np.minimum(core + SPAN, offs[doc + 1])
    first, last = np.maximum(core - MARGIN, offs[doc]), np.minimum(end + MARGIN, offs[doc + 1])
    length = -(-(last - first) // STEP) * STEP
    order = np.argsort(length, kind="stable")
    total = np.zeros((len(sizes), len(net.ob)))
    for at in range(0, len(order), READ):
        some = order[at : at + READ]
        place = first[some] + np.arange(length[some[-1]])[:, None]
        x = np.where(place < last[some], data[np.minimum(place, len(data) - 1)].astype(np.int64) + 1, 0)
        np.add.at(total, doc[some], net.sums(x, core[some] - first[some], end[some] - first[some]))
    return total / np.maximum(sizes, 1)[:, None]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, part) for each stretch of TRAIN bytes that has a letter of any script."""
    for b in batches:
        langs, texts = b.column(b.schema.get_field_index("lang")), b.column(b.schema.get_field_index("text"))
        for lang, text in zip(langs, texts):
            raw = text.as_py().encode()
            for at in range(0, len(raw), TRAIN * READ):
                parts = [raw[i : i + TRAIN] for i in range(at, min(at + TRAIN * READ, len(raw)), TRAIN)]
                parts = [p for p in parts if _letter.search(p.decode(errors="ignore"))]
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])


def learn(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Labels, in order, and the network's weights."""
    own = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    kinds = [r.lang for r in own.select("lang").distinct().orderBy("lang").collect()]  # the network has a label for each
    if not kinds:
        return [], []
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = own.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE).select("doc_id", F.col("lang").alias("kind"))
    # at most SAMPLE ids a language, so the texts stay where they are
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").where("lang = kind").select("lang", "text")
    parts = texts.mapInArrow(_stretches, "lang string, part binary").distinct()
    some = Window.partitionBy("lang").orderBy(F.xxhash64("part"), "part")
    parts = parts.withColumn("k", F.row_number().over(some)).where(F.col("k") <= STRETCHES)
    number, found = {k: i for i, k in enumerate(kinds)}, [(bytes(r.part), r.lang) for r in parts.orderBy("lang", "k").collect()]
    net = train([p for p, _ in found], np.array([number[k] for _, k in found], np.int64), len(kinds))
    return kinds, net.weights


def predict(docs: DataFrame, model: tuple[list[str], list[np.ndarray]]) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, weights = shared.value
        net = Network.of(weights) if kinds else None
        for b in batches:
            names, scores = [], []
            texts = b.column(b.schema.get_field_index("text"))
            for at, rows, data, offs in text_slices(b, "text"):
                p = pooled(net, data, offs) if kinds else np.zeros((rows, 1))
                best = p.argmax(1)
                for i in range(rows):
                    t = texts[at + i].as_py()
                    known = bool(kinds) and t is not None and _letter.search(t) is not None
                    names.append(kinds[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, float(p[i, best[i]])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("held_out")), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(go, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
