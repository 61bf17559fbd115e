"""The objects in the arrays of large JSON documents, found by many tasks.

A document is read as text whose lines end in `}`, so Spark splits it by bytes wherever it lies. What a piece means
depends on all text before it, hence three readings of the same splits:

1. each split's quotes and change of depth, whether or not it begins within a string;
2. from the state that each split begins in, which is known then: how many objects of which array begin in it;
3. the objects, each with its place. What a split's first and last object lack lies in its neighbours, and is joined
   to them by place.

The driver holds a few numbers a split, never text. Text of an object isn't looked into beyond its brackets.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..graph import delete_at_exit, shared_dir

ESCAPED = re.compile(r"\\.", re.S)
STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
REST = re.compile(f'({STRING})("?)', re.S)
TOKEN = re.compile(f'"({STRING})("?)|([{{}}\\[\\]])', re.S)
OBJECT = 3  # depth within an object of an array of the document
NUMBERS = "spark.sql.files.minPartitionNum"


class Malformed(ValueError):
    """A document whose brackets or quotes don't match."""


def _weigh(text: str, inside: int) -> tuple[int, int]:
    """Change of depth over text, and whether it ends within a string."""
    parts = (ESCAPED.sub("", text) if "\\" in text else text).split('"')
    bare = "".join(parts[inside::2])
    return bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]"), inside ^ (len(parts) - 1 & 1)


class Reader:
    """Reads pieces, which end in `}`, from a state on: within a string or not, depth, array, and how many objects of it
    have begun."""

    def __init__(self, inside: int = 0, depth: int = 0, array: str | None = None, begun: int = 0):
        self.inside, self.depth, self.array, self.begun = inside, depth, array, begun
        self.arrays: list[tuple[str | None, int]] = []  # those left, with what had begun
        self.name, self.text = None, []

    def _seek(self, piece: str) -> int | None:
        """Where an object begins; none if no object does."""
        at = 0
        if self.inside:
            rest = REST.match(piece)
            at, self.inside = rest.end(), int(not rest[2])
        for m in TOKEN.finditer(piece, at):
            bracket = m[3]
            if bracket is None:
                self.inside = int(not m[2])
                if self.depth == 1:
                    self.name = m[1]
            elif bracket in "{[":
                self.depth += 1
                if self.depth == OBJECT and bracket == "{":
                    self.begun += 1
                    return m.end() - 1
                if self.depth == 2:
                    self.arrays.append((self.array, self.begun))
                    self.array, self.begun = self.name, 0
            else:
                self.depth -= 1
        return None

    def read(self, piece: str) -> Iterator[tuple[str | None, int, str]]:
        """(array, place, text) of the object that ends with this piece, if one does."""
        start, body = 0, piece
        if self.depth < OBJECT:
            start = self._seek(piece)
            if start is None:
                return
            body = piece[start + 1 :]
        moved, self.inside = _weigh(body, self.inside)
        self.depth += moved
        self.text.append(piece[start:])
        if self.depth < OBJECT:
            yield self.array, self.begun - 1, "".join(self.text)
            self.text = []


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[list[str]]]]:
    """Lists of the pieces of each split, which lie together and in order within a task."""

    def lists():
        for b in batches:
            files, splits, values = (b.column(c) for c in ("file", "split", "value"))
            ends = [(files[i].as_py(), splits[i].as_py()) for i in (0, -1)] if len(b) else []
            if ends and ends[0] == ends[1]:
                yield ends[0], values.to_pylist()
            elif ends:
                rows = zip(files.to_pylist(), splits.to_pylist(), values.to_pylist())
                for at, some in groupby(rows, key=lambda r: r[:2]):
                    yield at, [r[2] for r in some]

    for at, group in groupby(lists(), key=lambda r: r[0]):
        yield at, (values for _, values in group)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([list(c) for c in zip(*rows)] or [[] for _ in schema], schema=schema)


def _depths(batches):
    for at, lists in _splits(batches):
        depth, inside = [0, 0], 0
        for values in lists:
            text = "}".join(values) + "}"
            (a, after), (b, _) = _weigh(text, inside), _weigh(text, 1 - inside)
            depth, inside = [depth[0] + a, depth[1] + b], after
        yield _batch(DEPTHS, [(*at, inside, *depth)])


def _arrays(states):
    def run(batches):
        for at, lists in _splits(batches):
            r = Reader(*states.value[at])
            for values in lists:
                for p in values:
                    for _ in r.read(p + "}"):
                        pass
            runs = [*r.arrays, (r.array, r.begun)]
            yield _batch(RUNS, [(*at, i, a, n) for i, (a, n) in enumerate(runs)])

    return run


def _objects(states, arrays):
    def run(batches):
        for at, lists in _splits(batches):
            state = states.value[at]
            r, cut = Reader(*state), state[1] >= OBJECT
            for values in lists:
                rows = []
                for p in values:
                    for array, place, text in r.read(p + "}"):
                        if array in arrays:
                            rows.append((*at, array, place, not cut, text))
                        cut = False
                yield _batch(FOUND, rows)
            if r.text and r.array in arrays:
                yield _batch(FOUND, [(*at, r.array, r.begun - 1, False, "".join(r.text))])

    return run


_at = [("file", pa.string()), ("split", pa.int64())]
DEPTHS = pa.schema([*_at, ("odd", pa.int32()), ("outside", pa.int64()), ("within", pa.int64())])
RUNS = pa.schema([*_at, ("run", pa.int32()), ("array", pa.string()), ("begun", pa.int64())])
FOUND = pa.schema([*_at, ("array", pa.string()), ("place", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])


def objects(spark: SparkSession, path: str, arrays: dict[str, StructType | None]) -> dict[str, DataFrame]:
    """Per array: (file, place, x), the objects in the arrays of that name of each document at path (one a file), parsed
    by its schema, or as text where that is None; place is counted from 0. Elements that aren't objects are left out. An
    array that stands twice in a document gives both. The objects are stored in the shared folder and read from there.
    Malformed if brackets or quotes don't match."""
    at = f"{shared_dir(spark)}/elements-{uuid.uuid4().hex}"
    delete_at_exit(spark, at)
    before = spark.conf.get(NUMBERS, None)
    # splits must be the same each time, also where executors come and go
    spark.conf.set(NUMBERS, before or str(spark.sparkContext.defaultParallelism))
    try:
        text = spark.read.option("lineSep", "}").text(path)
        text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
        states, file, inside, depth = {}, None, 0, 0

        def whole():
            if inside or depth not in (0, -1):  # a `}` too many is counted where text follows the last one
                raise Malformed(f"{file} isn't a whole document")

        # sorted here, a row a split: a sort in Spark would read the text once more to draw its sample
        for r in sorted(text.mapInArrow(_depths, from_arrow_schema(DEPTHS)).collect(), key=lambda r: (r.file, r.split)):
            if r.file != file:
                whole()
                file, inside, depth = r.file, 0, 0
            states[r.file, r.split] = (inside, depth)
            inside, depth = inside ^ r.odd, depth + (r.within if inside else r.outside)
        whole()
        known = spark.sparkContext.broadcast(states)  # a row a split
        begun, file = {}, None
        runs = text.mapInArrow(_arrays(known), from_arrow_schema(RUNS))
        for r in sorted(runs.collect(), key=lambda r: (r.file, r.split, r.run)):
            if r.file != file:
                file, array, n = r.file, None, 0
            if r.run == 0:
                begun[r.file, r.split] = (*states[r.file, r.split], array, n)
                n += r.begun
            else:
                array, n = r.array, r.begun
        found = text.mapInArrow(_objects(spark.sparkContext.broadcast(begun), set(arrays)), from_arrow_schema(FOUND))
        parse = lambda a: F.from_json("text", arrays[a]) if arrays[a] else F.col("text")
        parsed = [F.when(F.col("whole") & (F.col("array") == a), parse(a)).alias(f"x_{a}") for a in arrays]
        found = found.select("array", "whole", "file", "split", "place", F.when(~F.col("whole"), F.col("text")).alias("text"), *parsed)
        found.write.partitionBy("array", "whole").option("compression", "zstd").parquet(at)
        stored = spark.read.schema(found.schema).parquet(at)
    finally:
        spark.conf.unset(NUMBERS) if before is None else spark.conf.set(NUMBERS, before)
    parts = F.sort_array(F.collect_list(F.struct("split", "text")))  # an object's own text
    cut = stored.where("not whole").groupBy("array", "file", "place").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return {a: stored.where((F.col("array") == a) & F.col("whole")).select("file", "place", F.col(f"x_{a}").alias("x")).union(cut.where(F.col("array") == a).select("file", "place", parse(a))) for a in arrays}
