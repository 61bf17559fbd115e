"""Suffix-array dedup: repeated byte strings found by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of SIZE bytes that covers it starts anywhere else, in its document or another.

1. Candidates. Runs of SIZE-byte windows that share their least k-gram (rolling.runs) are one row. A key
   that stands at one place only can't repeat. Runs with equal text need one representative, whose weight is their number.
2. Keys whose runs differ, or stand in their run several times, are dealt to buckets of about BUCKET_BYTES of run text, by key, so equal windows
   meet. In a bucket, each shard of runs has its own suffix array and transform. They are merged by
   iterative interleave refinement: entries are ordered by the prefix compared so far; each turn puts
   two preceding symbols, read off the transforms, before it by a stable pass over these symbols, and a
   boundary stays wherever neighbours differ. Entries alone between boundaries have no equal and leave.
   After SIZE / 2 turns the intervals left have common prefixes of SIZE bytes: the repeats. No suffixes are
   sorted beyond their shard.
3. A key with more than HOT_BYTES of different run texts doesn't fit a bucket. Its runs are cut by their least
   gram of the next length of GRAMS and go through 1 and 2 again: equal windows have equal grams of any length,
   so they meet again. At the last length, SIZE, a key is a window, and those that stand twice are the repeats.

Defined results: null text has no bytes; strings never cross documents; repeated rows repeat each other's
bytes, whatever their ids; texts under SIZE bytes stay whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import SLICE_BYTES, longs, stored, table, text_slices
from .substring_dedup import SHIFT, WINDOWS, covered, pack, spans_of

SIZE = 200
GRAMS = 32, 100, 170, SIZE  # the last must be the size of a window
BUCKET_BYTES, SHARD_BYTES, HOT_BYTES = 1 << 20, 1 << 17, 1 << 22
RUNS = "key long, run long, doc long, tag long, span long, several boolean"


#: Symbols of 9 bits that one number holds.
PACKED = 7


def _symbols(data: np.ndarray) -> np.ndarray:
    return data.astype(np.uint64) + np.uint64(1)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of text's suffixes by their first depth symbols at least (prefix doubling; 0 ends a run).
    Each end is a symbol of its own, the first the least: suffixes alike up to their ends go by place."""
    n, h = len(text), PACKED
    first, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(h):
        symbol = np.zeros(n, np.int64)
        symbol[: max(n - k, 0)] = text[k:]
        open_ &= symbol != 0
        first = first << 9 | np.where(open_, symbol, 0)
    order = np.argsort(first, kind="stable")
    new, rank = np.zeros(n, np.int64), np.empty(n, np.int64)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | ~open_[order[1:]]
    rank[order] = np.cumsum(new)
    while h < depth and h < n and rank[order[-1]] < n - 1:
        after = np.full(n, -1, np.int64)
        after[:-h] = rank[h:]
        both = rank * (n + 1) + after + 1
        order = np.argsort(both)
        new[1:] = both[order[1:]] != both[order[:-1]]
        rank[order] = np.cumsum(new)
        h *= 2
    return order


class Shard:
    """A collection of runs: its suffix array and, by suffix rank, the two symbols before and where they lead."""

    def __init__(self, runs: list[bytes], depth: int):
        lengths = np.array([len(r) for r in runs])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = np.zeros(int((lengths + 1).sum()), np.uint16)
        for s, r in zip(starts, runs):
            text[s : s + len(r)] = np.frombuffer(r, np.uint8).astype(np.uint16) + 1
        self.order = suffix_array(text, depth)
        rank = np.empty(len(text), np.int64)
        rank[self.order] = np.arange(len(text))
        self.run = np.repeat(np.arange(len(runs)), lengths + 1)[self.order]
        self.offset = self.order - starts[self.run]
        before = np.maximum(self.order - 2, 0)  # a run's first two suffixes have no such symbols; none is asked for
        self.leads = rank[before]
        self.two = (((text[before].astype(np.int64) - 1) & 255) << 8 | ((text[before + (len(text) > 1)].astype(np.int64) - 1) & 255)).astype(np.uint16)


def repeated(runs: list[bytes], size: int = SIZE, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of all strings of size bytes (an even number) that runs hold twice or more."""
    shards, held, count = [], [], 0
    for r in runs:
        held.append(r)
        count += len(r)
        if count >= shard_bytes:
            shards.append(Shard(held, size))
            held, count = [], 0
    if held:
        shards.append(Shard(held, size))
    if not shards:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = np.cumsum([0] + [len(s.order) for s in shards])
    first = np.cumsum([0] + [int(s.run.max()) + 1 for s in shards])
    two, offset = np.concatenate([s.two for s in shards]), np.concatenate([s.offset for s in shards])
    leads = np.concatenate([s.leads + b for s, b in zip(shards, base)])
    # the interleave: entries (transform and place in it), in order of the prefix compared so far; they begin
    # at the places that have size symbols before them in their run
    entry = np.flatnonzero(offset >= size)
    interval = np.zeros(len(entry), np.int32)
    for _ in range(size // 2):
        symbols = two[entry]
        turn = np.argsort(symbols, kind="stable")
        symbols, interval = symbols[turn], interval[turn]
        bound = np.ones(len(turn) + 1, bool)
        bound[1:-1] = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(bound[:-1] & bound[1:])
        entry, interval = leads[entry[turn[shared]]], np.cumsum(bound[:-1], dtype=np.int32)[shared]
        if not len(entry):
            break
    run = np.concatenate([s.run + f for s, f in zip(shards, first)])[entry]
    return run, offset[entry]


def _emit_runs(size: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tags = longs(b, "doc"), longs(b, "tag")
            for at, _, data, offs in text_slices(b, "text"):
                key, whole, doc, start, n, several = R.runs(_symbols(data), offs, size, gram, True)
                doc = doc + at
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(docs[doc]), pa.array(tags[doc]), pa.array(pack(start, n)), pa.array(several)], ["key", "run", "doc", "tag", "span", "several"])

    return go


def _asked(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    want = b.column(b.schema.get_field_index("asked"))[i].values
    return want.field("span").to_numpy(), want.field("key").to_numpy()


def _emit_texts(size: int):
    """The bytes of the runs asked for."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tags = longs(b, "doc"), longs(b, "tag")
            for at, rows, data, offs in text_slices(b, "text"):
                raw, out = data.tobytes(), ([], [], [], [], [])
                for i in range(rows):
                    spans, keys = _asked(b, at + i)
                    for span, key in zip(spans.tolist(), keys.tolist()):
                        s = int(offs[i]) + (span >> SHIFT)
                        for x, v in zip(out, (key, docs[at + i], tags[at + i], span, raw[s : s + (span & WINDOWS) + size - 1])):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "doc", "tag", "span", "bytes"])

    return go


def _emit_split(size: int, gram: int):
    """The runs asked for, cut by their least gram."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tags = longs(b, "doc"), longs(b, "tag")
            for at, rows, data, offs in text_slices(b, "text"):
                for i in range(rows):
                    spans, _ = _asked(b, at + i)
                    begin, length = spans >> SHIFT, (spans & WINDOWS) + (size - 1)
                    piece = (np.cumsum(length) - length) // SLICE_BYTES  # runs overlap: together they are longer than the text
                    for k in np.unique(piece):
                        s, n = begin[piece == k], length[piece == k]
                        first = np.concatenate([[0], np.cumsum(n)])
                        symbols = _symbols(data[offs[i] + np.repeat(s - first[:-1], n) + np.arange(first[-1])])
                        key, whole, run, start, count, several = R.runs(symbols, first, size, gram, True)
                        same = [pa.array(np.full(len(key), x[at + i])) for x in (docs, tags)]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), *same, pa.array(pack(s[run] + start, count)), pa.array(several)], ["key", "run", "doc", "tag", "span", "several"])

    return go


def _merge(size: int):
    """Spans of the repeats in one bucket."""

    def go(rows: pa.Table) -> pa.Table:
        docs, tags, spans = (rows[c].to_numpy() for c in ("doc", "tag", "span"))
        run, offset = repeated(rows["bytes"].to_pylist(), size)
        order = np.lexsort((offset, run))
        run, offset = run[order], offset[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)
        head = np.flatnonzero(new)
        n, own = np.diff(np.append(head, len(run))), run[head]
        found = pack((spans[own] >> SHIFT) + offset[head], n)
        return pa.table({"doc": pa.array(docs[own], pa.int64()), "tag": pa.array(tags[own], pa.int64()), "span": pa.array(found, pa.int64())})

    return go


def repeated_spans(docs: DataFrame, size: int = SIZE, grams: tuple[int, ...] = GRAMS, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc, tag, spans) of docs (doc, tag, text): which windows start anywhere else."""
    own = docs.where("text is not null")
    once, all_found = own.dropDuplicates(["doc", "tag"]), []
    runs = own.mapInArrow(_emit_runs(size, grams[0]), RUNS)
    for gram, longer in zip(grams, (*grams[1:], None)):
        found, kinds = _equal_runs(runs, F.lit(gram == size))
        all_found.append(found)
        length = F.col("span").bitwiseAND(F.lit(WINDOWS)) + (size - 1)
        of_key = stored(kinds.groupBy("key").agg(F.sum(length).alias("bytes")), "suffix-bytes")
        hot = of_key.where(F.col("bytes") > hot_bytes).select("key")
        total, hottest = of_key.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
        split = hottest > hot_bytes
        calm = kinds.join(hot, "key", "left_anti") if split else kinds
        texts = once.join(_asked_for(calm), ["doc", "tag"]).mapInArrow(_emit_texts(size), "key long, doc long, tag long, span long, bytes binary")
        texts = texts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, int(total) // bucket_bytes))))
        all_found.append(stored(texts.groupBy("bucket").applyInArrow(_merge(size), "doc long, tag long, span long"), "suffix-merged"))
        if not split:
            break
        runs = stored(once.join(_asked_for(kinds.join(hot, "key", "left_semi")), ["doc", "tag"]).mapInArrow(_emit_split(size, longer), RUNS), "suffix-split")
    return functools.reduce(DataFrame.union, all_found).groupBy("doc", "tag").agg(F.collect_set("span").alias("spans"))


def _asked_for(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc", "tag").agg(F.collect_set(F.struct("key", "span")).alias("asked"))


def _equal_runs(runs: DataFrame, windows: Column) -> tuple[DataFrame, DataFrame]:
    """Spans of runs that stand twice as a whole; and one run of each text, of the keys whose runs differ.
    Where keys are windows, all runs of a key that stands twice are such spans."""
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("r0"), F.max("run").alias("r1"), F.max("several").alias("inside")).where("n > 1 or inside")
    keys = stored(keys.select("key", (windows | F.expr("n > 1 and r0 = r1")).alias("pure")), "suffix-keys")
    shared = stored(runs.drop("several").join(keys, "key"), "suffix-runs")
    mixed = shared.where("not pure")
    kinds = mixed.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag", "span")).alias("first"))
    kinds = stored(kinds.select("key", "run", "n", "first.doc", "first.tag", "first.span"), "suffix-kinds")
    copies = kinds.where("n > 1").select("key", "run")
    own_span = ["doc", "tag", "span"]
    return shared.where("pure").select(*own_span).union(mixed.join(copies, ["key", "run"]).select(*own_span)), kinds


def _cut(size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, rows, data, offs in text_slices(b, "text"):
                for i in range(rows):
                    own = data[offs[i] : offs[i + 1]]
                    gone = covered(len(own), spans_of(b, at + i), size)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    out.append((len(own), int(gone.sum()), len(edges) // 2, list(zip(edges[0::2].tolist(), edges[1::2].tolist())), hashlib.sha256(own[~gone].tobytes()).hexdigest()))
            spans = pa.array([[{"start": s, "end": e} for s, e in x[3]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            long = lambda k: pa.array([x[k] for x in out], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), long(0), long(1), long(2), spans, pa.array([x[4] for x in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])

    return go


def suffix_dedup(docs: DataFrame, size: int = SIZE, grams: tuple[int, ...] = GRAMS, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, removed (byte intervals), kept_sha256."""
    # rows are known by two hashes of id and text: equal rows have equal spans
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"), F.xxhash64("text", "doc_id").alias("tag"))
    spans = repeated_spans(rows.select("doc", "tag", "text"), size, grams, bucket_bytes, hot_bytes)
    return rows.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(size), "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
