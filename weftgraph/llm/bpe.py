"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each pair of neighbours that has a rank waits in that rank's
bucket, as its left position. A bitmap over ranks, in words, and a bitmap over the words give the least
rank that has anything waiting (find-first-set at each level); its leftmost position is merged. A pair that has changed since is stale and skipped. No step depends on the pre-token's length
but the bucket's heap, so one of millions of bytes takes n log n.

Short pre-tokens repeat, so a worker keeps their ids in a dictionary of bounded size.

Defined results: null text encodes as empty text; the special tokens' strings are ordinary text; other
columns are untouched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens of at most KEEP_CHARS characters are kept, KEEP of them (some 170 MB), the later half for longer.
KEEP, KEEP_CHARS = 700_000, 40
#: Pre-tokens that one step handles.
STEP = 1 << 16


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, lines: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]
        self.pattern = regex.compile(pattern)
        # ranks in words of 2**shift bits, and one bitmap of the words that aren't empty
        self.shift = max(1, -(-len(self.bytes).bit_length() // 2))
        self.words = [0] * ((len(self.bytes) >> self.shift) + 1)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        n, shift, words = len(piece), self.shift, self.words  # all words are 0 between pieces
        mask, top = (1 << shift) - 1, 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # the rank of a part with the one after it
        bucket: dict[int, list[int]] = {}
        for i in range(n - 1):
            if (r := rank_of(piece[i : i + 2])) is not None:
                pair[i] = r
                if r in bucket:
                    bucket[r].append(i)
                else:
                    bucket[r] = [i]
                    words[r >> shift] |= 1 << (r & mask)
                    top |= 1 << (r >> shift)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << shift) + (word & -word).bit_length() - 1
            waiting = bucket[rank]
            if len(waiting) > 1:
                at = heappop(waiting)
            else:
                at = waiting[0]
                del bucket[rank]
                words[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[at] = after[gone]
            pair[gone] = None
            changed = []
            if end < n:
                before[end] = at
                pair[at] = r = rank_of(piece[at : after[end]])
                if r is not None:
                    changed.append((r, at))
            else:
                pair[at] = None
            left = before[at]
            if left >= 0:
                pair[left] = r = rank_of(piece[left:end])
                if r is not None:
                    changed.append((r, left))
            for r, i in changed:
                if r in bucket:
                    heappush(bucket[r], i)
                else:
                    bucket[r] = [i]
                    words[r >> shift] |= 1 << (r & mask)
                    top |= 1 << (r >> shift)
        out, at, ranks = [], 0, self.ranks
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def _missed(self, token: str) -> tuple[int, ...]:
        """Ids of a pre-token that isn't among the newer half of those kept."""
        ids = self.older.get(token) or tuple(self.encode_piece(token.encode()))
        if len(token) <= KEEP_CHARS:
            if len(self.kept) >= KEEP // 2:
                self.older, self.kept = self.kept, {}
            self.kept[token] = ids
        return ids

    def steps(self, text: str) -> Iterator[list[int]]:
        """A text's ids, those of at most STEP pre-tokens at a time."""
        if len(text) <= STEP * 4:
            groups = [self.pattern.findall(text)]
        else:
            found = (m[0] for m in self.pattern.finditer(text))
            groups = iter(lambda: list(islice(found, STEP)), [])
        missed = self._missed
        for tokens in groups:
            kept = self.kept.get
            yield list(chain.from_iterable([kept(t) or missed(t) for t in tokens]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.steps(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hash of the ids, hash of the bytes they decode to."""
        n, names, back, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
        for ids in self.steps(text):
            if ids:
                n += len(ids)
                names.update((gap + " ".join(map(self.names.__getitem__, ids))).encode())
                back.update(self.decode(ids))
                gap = " "
        return n, names.hexdigest(), back.hexdigest()


def _coder(lines: bytes) -> Coder:
    """One coder a worker, kept from task to task."""
    return held(("bpe", hash(lines)), lambda: Coder(lines))


def rank_file(path: str = RANKS) -> bytes:
    """The rank file, under a megabyte, as the driver hands it to the workers."""
    with open(path, "rb") as f:
        return f.read()


def digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            for at in range(0, b.num_rows, 256):
                rows = texts.slice(at, 256)
                out = [coder.digest(t.as_py() or "") for t in rows]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).slice(at, 256), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Per row of docs: doc_id, ids, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for t in part.column(part.schema.get_field_index("text")):
                    ids = coder.encode(t.as_py() or "")
                    rows.append((ids, len(ids), hashlib.sha256(" ".join(map(coder.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
                kinds = [pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs with a column ids; an existing column of that name is replaced."""
    rest = [c for c in docs.columns if c not in ("text", "ids")]
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = pa.array([coder.encode(t.as_py() or "") for t in part.column("text")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("text"), ids], ["rest", "text", "ids"])

    rows = docs.select(F.struct(*rest).alias("rest") if rest else F.lit(0).alias("rest"), "text")
    out = rows.mapInArrow(go, f"rest {rows.schema['rest'].dataType.simpleString()}, text string, ids array<int>")
    return out.select(*[F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns if c != "ids"], "ids")


def decode_documents(docs: DataFrame, ids: str = "ids", path: str = RANKS) -> DataFrame:
    """docs with a binary column ``decoded`` of what the ids stand for; null ids decode to no bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    @F.pandas_udf("binary")
    def decoded(col):
        import pandas as pd

        coder = _coder(shared.value)
        return pd.Series([coder.decode(x) if x is not None else b"" for x in col])

    return docs.withColumn("decoded", decoded(F.col(ids)))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
