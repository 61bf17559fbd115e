"""Substring dedup by Rabin-Karp window hashes.

Every window of ``size`` consecutive words is hashed. Spark counts the hashes in two steps so that
neither disk nor any task grows with the copies:

1. Runs of windows that share their least k-gram are one row (see rolling.runs). Runs are grouped by
   that key; where a document with a smaller id has the very same run, all its windows repeat.
2. Runs that share the key but differ (the edge of a passage, an edit) are compared window by window,
   the smallest document of each distinct run standing for its copies.

Windows found in a smaller document become word intervals, merged to maximal ones when the text is cut.
Hot keys: counting is partial before each shuffle, and looking counts up is an equi-join of two stored
or scanned tables, which adaptive execution splits. Keys are pairs of 64-bit hashes.

A run or window is known by two 64-bit hashes, its own and its key's; fingerprints are modulo a prime, so no
texts, however they are made, meet more often than chance has it (see rolling).

Defined results: null text has no words, no bytes are removed and the kept text is empty; texts under
``size`` words are kept whole; rows with the same doc_id never remove each other's words, and each gets
the intervals of its own text; a text of any length is one row of a batch, in some 60 bytes of memory a byte; a null doc_id is kept whole and removes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import longs, stored, table, text_slices

WINDOW = 50
GRAM = 25
#: A span is start << SHIFT | windows; a run has fewer than 2**SHIFT windows, and starts have 43 bits.
SHIFT, WINDOWS = 20, (1 << 20) - 1


def _tag() -> Column:
    """What tells rows apart that wrongly share a doc_id, so that they don't take each other's spans."""
    return F.xxhash64("text").alias("tag")


def pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << SHIFT) | n


def emit_runs(size: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = longs(b, "doc_id"), longs(b, "tag")
            for at, rows, data, offs in text_slices(b, "text"):
                starts, ends, first = R.word_spans(data, offs)
                key, whole, doc, start, n = R.runs(R.word_hashes(data, starts, ends), first, size, gram)
                doc = doc + at
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[doc]), pa.array(tags[doc]), pa.array(pack(start, n))], ["key", "run", "doc_id", "tag", "span"])

    return go


def emit_windows(size: int):
    """Every window of the runs asked for: key, window hash, document, span of one window."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = longs(b, "doc_id"), longs(b, "tag")
            asked = b.column(b.schema.get_field_index("asked"))
            for at, rows, data, offs in text_slices(b, "text"):
                starts, ends, first = R.word_spans(data, offs)
                hashes = R.window_hashes(R.word_hashes(data, starts, ends), size)
                for i in range(rows):
                    want = asked[at + i].values
                    spans = want.field("span").to_numpy()
                    keys = want.field("key").to_numpy()
                    n, s = spans & WINDOWS, spans >> SHIFT
                    total = int(n.sum())
                    if not total:
                        continue
                    pos = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(total)
                    h = hashes[first[i] + pos]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(h.view(np.int64)), pa.array(np.full(total, ids[at + i])), pa.array(np.full(total, tags[at + i])), pa.array(pack(pos, np.ones(total, np.int64)))], ["key", "window", "doc_id", "tag", "span"])

    return go


def covered(n: int, spans: np.ndarray, size: int) -> np.ndarray:
    """Which of n symbols the windows of these spans cover."""
    delta = np.zeros(n + 1, np.int64)
    s = spans >> SHIFT
    e = np.minimum(s + (spans & WINDOWS) + size - 1, n)
    np.add.at(delta, s, 1)
    np.add.at(delta, e, -1)
    return np.cumsum(delta[:n]) > 0


def spans_of(b: pa.RecordBatch, i: int) -> np.ndarray:
    cell = b.column(b.schema.get_field_index("spans"))[i]
    return cell.values.to_numpy() if cell.is_valid else np.zeros(0, np.int64)


def cut(size: int, texts: bool):
    """Per document: words, words removed, maximal removal intervals, and what is left."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, rows, data, offs in text_slices(b, "text"):
                starts, ends, first = R.word_spans(data, offs)
                raw = data.tobytes()
                for i in range(rows):
                    lo, hi = int(first[i]), int(first[i + 1])
                    spans = spans_of(b, at + i)
                    gone = covered(hi - lo, spans, size)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    keep = np.flatnonzero(~gone) + lo
                    if texts and not len(spans):
                        left = raw[offs[i] : offs[i + 1]]  # untouched documents keep their spacing
                    else:
                        left = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
                    out.append((hi - lo, int(gone.sum()), list(zip(edges[0::2].tolist(), edges[1::2].tolist())), left))
            rest = [b.column(k) for k, f in enumerate(b.schema) if f.name not in ("text", "spans")]
            names = [f.name for f in b.schema if f.name not in ("text", "spans")]
            spans = pa.array([[{"start": s, "end": e} for s, e in x[2]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            last = pa.array([x[3].decode() for x in out], pa.string()) if texts else pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), spans, last], [*names, "n_words", "n_removed", "removed", "text" if texts else "kept_sha256"])

    return go


def removal_spans(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, spans): which windows of each document start in a smaller document too."""
    own = docs.where("doc_id is not null and text is not null").select("doc_id", "text", _tag())
    runs = own.mapInArrow(emit_runs(size, gram), "key long, run long, doc_id long, tag long, span long")
    keys = runs.groupBy("key").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("run").alias("r0"), F.max("run").alias("r1"))
    keys = stored(keys.where("d0 < d1").select("key", "d0", (F.col("r0") == F.col("r1")).alias("pure")), "substring-keys")
    shared = stored(runs.join(keys, "key"), "substring-runs")
    mixed = shared.where("not pure")
    kinds = stored(mixed.groupBy("key", "run").agg(F.min("doc_id").alias("c0")), "substring-kinds")
    mixed = stored(mixed.drop("d0", "pure").join(kinds, ["key", "run"]), "substring-mixed")
    # sets, not lists: a row that stands many times has its spans once
    asked = mixed.where("doc_id = c0").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("key", "span")).alias("asked"))
    windows = own.dropDuplicates(["doc_id", "tag"]).join(asked, ["doc_id", "tag"]).select("doc_id", "tag", "text", "asked").mapInArrow(emit_windows(size), "key long, window long, doc_id long, tag long, span long")
    windows = stored(windows, "substring-windows")
    seen = stored(windows.groupBy("key", "window").agg(F.min("doc_id").alias("w0"), F.max("doc_id").alias("w1")).where("w0 < w1"), "substring-seen")
    own_span = ["doc_id", "tag", "span"]
    found = shared.where("pure and doc_id > d0").select(*own_span)
    found = found.union(mixed.where("doc_id > c0").select(*own_span))
    found = found.union(windows.join(seen, ["key", "window"]).where("doc_id > w0").select(*own_span))
    return found.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans"))


def substring_dedup(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, removed (maximal word intervals), kept_sha256."""
    spans = removal_spans(docs, size, gram)
    rows = docs.select("doc_id", "text", _tag()).join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut(size, False), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string")


def without_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the repeated words cut out of text; documents that lose nothing keep their spacing."""
    spans = removal_spans(docs, size, gram)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", _tag(), F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"))
    rows = rows.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "rest", "spans")
    kind = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(cut(size, True), f"doc_id long, rest {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, text string")
    return out.select(*[F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "removed")
