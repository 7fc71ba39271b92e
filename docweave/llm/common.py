"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.scratch import settled, shared_dir

materialize = settled


def scratch(name: str) -> str:
    """A folder name of its own for tables that are dropped together."""
    return f"{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Drops what was materialized under a scratch folder; nothing may depend on it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/docweave/{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_checked(left: DataFrame, right: DataFrame, on, how: str, max_rows: int) -> DataFrame:
    """Joins, and broadcasts ``right`` only if its counted rows are ``max_rows`` at most."""
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000):
    """Jobs that run inside hand long texts to Python in Arrow batches of few rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: By operator, what frees the memory that it keeps in this Python worker from task to task.
_keepers: dict[str, Callable[[], None]] = {}


def keeps(operator: str, free: Callable[[], None]) -> None:
    _keepers[operator] = free


def begins(operator: str) -> None:
    """A task of ``operator`` begins: what others have kept in this worker goes back to the system, as their next task may never come."""
    others = [name for name in _keepers if name != operator]
    for name in others:
        _keepers.pop(name)()
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (one column); columns of ``docs`` may have any names."""
    name = f"of_{uuid.uuid4().hex}"
    return docs.join(gone.toDF(name), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


# Word hashing over UTF-8 buffers.  Words are maximal runs of bytes other than
# space and \t..\r; A-Z count as a-z.  All steps are NumPy passes over a block.

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        _powers[:] = []
        for base in (_R, _R_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Hashes of all words of a block of texts.

    ``data`` holds the block's bytes and ``offsets`` where each text begins and
    ends in it.  Returns the 64-bit hashes, the byte starts and ends of the
    words, and for each text the index of its first word (and the total).
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.uint64)
        return empty, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, np.bool_)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (edge[:n] | np.concatenate(([True], space[:-1]))))
    ends = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    power, inverse = power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _SAME)[data] * power[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def text_blocks(column, limit: int = 1 << 20):
    """Yields (first row, bytes, offsets) for blocks of an Arrow string column.

    A block has at most ``limit`` bytes or one text; null counts as empty.
    """
    import pyarrow as pa

    column = pa.array(column) if not isinstance(column, pa.Array) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
