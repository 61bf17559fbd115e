"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as UTF-8 bytes, A-Z in lower case, each run of ASCII white space as one space, none at
the ends. A document holds an item of m bytes if some stretch of it is at most k = m * EDITS // 100 edits
away. Such a stretch keeps at least m + 1 - q * (k + 1) of the item's q-grams, on diagonals at most k from
its own. So, for each document:

1. its q-grams are looked up among all items' (a bitmap, then a sorted table);
2. hits are counted by item, then by item and diagonal band; bands are 2 * (2k + 1) wide and overlap by
   half, so that one of them has all the hits of a stretch;
3. bands that reach the item's bound are verified by banded alignment, with both ends free.

q is at most Q, and less for short items, so that the bound is at least 1: nothing within the budget is lost.
Documents never leave their task. Items go to the tasks in blocks of at most BLOCK_BYTES; a larger
benchmark takes more passes.

Defined results: null texts hold nothing and are no items, nor are items without a byte once normalised; an
item too short for an edit counts wherever its bytes stand, inside a word too;
repeated items and rows each count; a null doc_id is reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import rolling as R
from .common import stored, table, text_slices

EDITS, Q, LEAST = 10, 8, 1
BLOCK_BYTES = 16 << 20
_BITS = 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32

SCHEMA = "doc_id long, item_id long, edits int, begin int, end int"


def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their documents' offsets, and each byte's place in data."""
    low = _LOWER[data]
    space = low == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space after a word
    heads = offs[:-1][offs[:-1] < offs[1:]]
    keep[heads[space[heads]]] = False
    at = np.flatnonzero(keep)
    edges = np.searchsorted(at, offs)
    # a space that ends a document
    full = edges[1:] > edges[:-1]
    last = edges[1:][full] - 1
    drop = last[space[at[last]]]
    if len(drop):
        at = np.delete(at, drop)
        edges = np.searchsorted(at, offs)
    return low[at], edges, at


def normal_bytes(text: str) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normal(raw, np.array([0, len(raw)]))[0].tobytes()


def banded(item: np.ndarray, doc: np.ndarray, base: int, width: int, most: int) -> tuple[int, int]:
    """Least edits that turn item into a stretch of doc, and where that ends. The alignment stays on diagonals
    base to base + width - 1 and may begin on any of them. Gives up once all its cells exceed most."""
    cols = np.arange(width)
    cost = np.zeros(width, np.int64)
    cost[cols + base < 0] = 1 << 20
    cost[cols + base > len(doc)] = 1 << 20
    padded = np.full(len(item) + width + 1, -1, np.int64)
    lo, hi = max(0, base), min(len(doc), base + len(padded))
    if hi > lo:
        padded[lo - base : hi - base] = doc[lo:hi]
    for i, c in enumerate(item):
        step = cost + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - cols) + cols
        out = cols + (base + i + 1 - len(doc))
        cost[out > 0] = 1 << 20
        if i & 7 == 7 and cost.min() > most:
            break
    best = int(cost.argmin())
    return int(cost[best]), base + len(item) + best


class Items:
    """Benchmark items and the tables of their q-grams."""

    def __init__(self, items: list[tuple[int | None, bytes]], edits: int = EDITS, q: int = Q, least: int = LEAST):
        self.items = [(i, np.frombuffer(b, np.uint8)) for i, b in items if len(b) >= least]
        self.k = np.array([len(b) * edits // 100 for _, b in self.items], np.int64)
        m = np.array([len(b) for _, b in self.items], np.int64)
        qs = np.minimum(q, m // (self.k + 1))
        self.need = m + 1 - qs * (self.k + 1)
        self.half = 2 * self.k + 1
        self.tables = []
        for one in sorted(set(qs.tolist())):
            own = np.flatnonzero(qs == one)
            hashes = [R.Sums(self.items[i][1].astype(np.uint64) + np.uint64(1)).grams(one) for i in own]
            which = np.repeat(own, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            allof = np.concatenate(hashes)
            order = np.argsort(allof, kind="stable")
            keys, first = np.unique(allof[order], return_index=True)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((one, bitmap, keys, np.append(first, len(order)), which[order], place[order]))

    def bands(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows (document, item, first diagonal) of the bands that reach their item's bound."""
        found, n = [], max(1, len(self.items))
        for q, bitmap, keys, first, which, place in self.tables:
            grams = R.Sums(data.astype(np.uint64) + np.uint64(1)).grams(q)
            at = np.flatnonzero(bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
            row = np.searchsorted(keys, grams[at])
            row[row == len(keys)] = 0
            hit = keys[row] == grams[at]
            at, row = at[hit], row[hit]
            doc = np.searchsorted(offs, at, "right") - 1
            inside = at + q <= offs[doc + 1]
            at, row, doc = at[inside], row[inside], doc[inside]
            count = first[row + 1] - first[row]
            total = int(count.sum())
            if not total:
                continue
            entry = np.repeat(first[row] - (np.cumsum(count) - count), count) + np.arange(total)
            item, doc = which[entry], np.repeat(doc, count)
            pair = doc * n + item
            if (len(offs) - 1) * n <= 1 << 24:
                enough = np.bincount(pair, minlength=(len(offs) - 1) * n)[pair] >= self.need[item]
            else:
                _, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
                enough = counts[back] >= self.need[item]
            if not enough.any():
                continue
            pair, item, doc = pair[enough], item[enough], doc[enough]
            diagonal = np.repeat(at, count)[enough] - offs[doc] - place[entry[enough]] + (1 << 20)
            half = self.half[item]
            block = diagonal // half  # a band is two blocks: this one and the next, or the one before and this
            both, twin = np.concatenate([block, block - 1]), np.concatenate([pair, pair])
            gram = np.concatenate([place[entry[enough]]] * 2)
            order = np.lexsort((gram, both, twin))
            both, twin, gram = both[order], twin[order], gram[order]
            head = np.ones(len(order), bool)
            head[1:] = (both[1:] != both[:-1]) | (twin[1:] != twin[:-1])
            once = head.copy()
            once[1:] |= gram[1:] != gram[:-1]  # an item's q-gram counts once a band
            at = np.flatnonzero(head)
            counts = np.add.reduceat(once, at, dtype=np.int64)
            index = order[at] % len(pair)
            good = counts >= self.need[item[index]]
            index, at = index[good], at[good]
            found.append(np.stack([doc[index], item[index], both[at] * self.half[item[index]] - (1 << 20)], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def matches(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, edits, begin, end) of the best stretch of each document and item, in normalised bytes."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, item, diagonal in self.bands(data, offs).tolist():
            text, own, k = data[offs[doc] : offs[doc + 1]], self.items[item][1], int(self.k[item])
            old = best.get((doc, item))
            if old and old[0] == 0:
                continue
            base = diagonal - k
            cost, end = banded(own, text, base, 2 * int(self.half[item]) + 2 * k, k)
            if cost <= k and (old is None or (cost, end) < old):
                best[doc, item] = (cost, end)
        for (doc, item), (cost, end) in sorted(best.items()):
            text, own, k = data[offs[doc] : offs[doc + 1]], self.items[item][1], int(self.k[item])
            tail = text[max(0, end - len(own) - k) : end]
            _, size = banded(own[::-1], tail[::-1], -k, 2 * k + 1, k) if cost else (0, len(own))
            yield doc, item, cost, max(0, end - size), end


def _find(batches: Iterator[pa.RecordBatch], own: Items) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows = b.column(b.schema.get_field_index("doc_id")), []
        for at, _, data, offs in text_slices(b, "text"):
            low, edges, place = normal(data, offs)
            for doc, item, cost, begin, end in own.matches(low, edges):
                where = place[edges[doc] : edges[doc + 1]] - offs[doc]
                rows.append((ids[at + doc].as_py(), own.items[item][0], cost, int(where[begin]) if begin < len(where) else 0, int(where[end - 1]) + 1))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items, normalised, in blocks of at most size bytes (one item at least); the driver holds one block."""
    block, held = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        b = normal_bytes(r.text)
        if block and held + len(b) > size:
            yield block
            block, held = [], 0
        block.append((r.item_id, b))
        held += len(b)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: int = EDITS, q: int = Q, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, begin, end (bytes of the document's text) of each item that a document holds."""
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Items(block, edits, q))
        part = docs.select("doc_id", "text").mapInArrow(lambda batches, shared=shared: _find(batches, shared.value), SCHEMA)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _clean(batches: Iterator[pa.RecordBatch], own: Items) -> Iterator[pa.RecordBatch]:
    """The rows that hold no item."""
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        for at, _, data, offs in text_slices(b, "text"):
            low, edges, _ = normal(data, offs)
            for doc, *_ in own.matches(low, edges):
                keep[at + doc] = False
        yield b.filter(pa.array(keep))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item. Rows with one doc_id go together; a row without one is
    judged by its own text."""
    gone = stored(contaminated(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "decontaminate-gone")
    alone = docs.where("doc_id is null")
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Items(block, EDITS, Q))
        alone = alone.mapInArrow(lambda batches, shared=shared: _clean(batches, shared.value), docs.schema)
    return docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns).union(alone)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
