"""What the operators share: table access, the shared folder, and Arrow batch slicing.

Executors may be lost at any time, so nothing is kept on one machine: intermediate tables are
written as Parquet to the folder named by ``spark.checkpoint.dir``, which the whole cluster sees.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word, as all contracts define it: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Bytes of text that one numpy step handles; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch at most. Texts are long, and a batch stands in the JVM and in Python at once.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the directory. Bounds the session's Arrow batches, which any operator may read it in."""
    if int(spark.conf.get(_ROWS)) > BATCH_ROWS or int(spark.conf.get(_ROWS)) <= 0:
        spark.conf.set(_ROWS, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_places: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where that is unset, a folder of our own, but on
    one machine only: on a cluster each executor would write to a disk that no other reads."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
        _own[spark.sparkContext.applicationId] = at  # the setting can't be changed in a running session
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends, or by release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not _places:  # not at import: what is registered after the JVM's start runs before its end
        atexit.register(release, 0)
    _places.append((path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at))
    return path


def _delete(store, at) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        store.delete(at, True)


def taken() -> int:
    """How many places there are, for release()."""
    return len(_places)


def release(since: int, *keep: str) -> None:
    """Deletes the places made since taken() gave that number, but for keep: for a step whose result is stored."""
    for path, store, at in [p for p in _places[since:] if p[0] not in keep]:
        _delete(store, at)
    _places[since:] = [p for p in _places[since:] if p[0] in keep]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    return stored_at(df, place(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task: one object at a time, with its dictionaries."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def text_slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, holds: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) of consecutive rows of at most ``limit`` bytes together,
    but one row at least. Null texts have no bytes. No copy of the texts is made.
    Unless the caller holds something itself, what the worker held for another operator goes."""
    if not holds:
        _held.clear()
    col = batch.column(batch.schema.get_field_index(text))
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end - row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of longs; nulls become the smallest long."""
    return batch.column(batch.schema.get_field_index(name)).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
