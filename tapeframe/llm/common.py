"""Helpers shared by the training-data operators.

Conventions of every operator here: a null text counts as empty, a null group
key is a group of its own, empty tables give empty results, and columns of the
input that clash with the operator's own are replaced.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once by the numpy kernels; one longer text is handled alone.
SLICE_BYTES = 1 << 20

#: Runs of words that gram_hashes handles at once.
GRAMS = 1 << 17

#: Rows that may be broadcast or collected where a docstring says "small".
SMALL_ROWS = 50_000

#: Rows of a few numbers that one task writes at least, where the number of rows is known.
TASK_ROWS = 20_000


#: Bytes of an Arrow batch between the JVM and Python, at most: four of them are in flight in a task.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES: with thousands of whole texts they would take hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns that clash (case-insensitively) with names."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name), F.lit(""))


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, deleted when it ends.

    Where that is unset, a local session gets a temporary folder and a cluster an error:
    no executor could read what another wrote to its own disk.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local_folders:
            _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tapeframe-")
        base = _local_folders[context.applicationId]
    folder = f"{base.rstrip('/')}/tapeframe-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for cut_lineage that is deleted at the end: for tables that no result reads any more."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, rows: int | None = None, each: int = TASK_ROWS, folder: str | None = None) -> DataFrame:
    """df written to the shared folder (or one below it) as a table and read again.

    rows: a bound on df's rows, where one is known and a row is a few numbers; then as many
    tasks write it as have `each` rows, so that small tables are not dealt over a large
    cluster's partitions. It also shrinks the stage that makes df: not for texts.

    It survives lost executors, and its size is known: a checkpointed DataFrame keeps the size
    that was estimated for its plan, and those of a loop's joins multiply without end.
    """
    path = f"{folder or shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (__ for a dot) while the block runs; what it computes must be written in it."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), str(v).lower() if isinstance(v, bool) else str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its measured row count is at most SMALL_ROWS."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def fields(schema: T.StructType, *more: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in more}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(more))


# ---------------------------------------------------------------- Arrow and numpy


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(data, np.uint8, last - first, first) if data and last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most so many bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        _, offsets = strings(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    _give_back()


def _give_back() -> None:
    """Returns freed memory to the system at a task's end: idle Python workers stay with all they once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        names.append(name)
        arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


# ---------------------------------------------------------------- hashes of words

#: Odd multiplier of the polynomial, its inverse modulo 2**64, and the finalizer's multipliers.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ..: n of them, a segment's at most, so a worker keeps two tables of that size."""
    if n > SLICE_BYTES + 1:
        raise ValueError("texts are hashed in segments of SLICE_BYTES")
    if base not in _powers:
        known = np.full(SLICE_BYTES + 1, base, np.uint64)
        known[0] = 1
        _powers[base] = np.multiply.accumulate(known)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Cumulative polynomial of SLICE_BYTES at most, from which span_hash takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal bytes, equal hash; 64 bits."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    shifted = (prefix[ends] - prefix[starts]) * _power(_BASE_INVERSE, int(starts.max()) + 1)[starts]
    return mixed(shifted + (ends - starts).astype(np.uint64))


def _long_hash(data: np.ndarray) -> np.uint64:
    """span_hash of all of data, slice by slice."""
    total, factor, step = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.array([pow(_BASE, SLICE_BYTES, 1 << 64)], np.uint64)
    for start in range(0, len(data), SLICE_BYTES):
        part = data[start : start + SLICE_BYTES]
        total = total + factor * (_BYTE_CODES[part] * _power(_BASE, len(part))).sum(dtype=np.uint64)
        factor = factor * step
    return mixed(total + np.uint64(len(data)))[0]


def hashed_runs(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of bytes that are true in `solid`, cut at offsets.

    Goes through the bytes in segments of SLICE_BYTES that end between runs, so that what it
    needs besides its results doesn't grow with the texts.
    """
    found, start, n = [], 0, len(data)
    while start < n:
        stop = min(start + SLICE_BYTES, n)
        if stop < n:
            gaps = np.flatnonzero(~solid[data[start:stop]])
            text = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            end = max(start + int(gaps[-1]) + 1 if len(gaps) else 0, text)
            if end <= start:  # one run, longer than a segment
                text = int(offsets[np.searchsorted(offsets, start, side="right")])
                while stop < text and solid[data[stop - 1]]:
                    gaps = np.flatnonzero(~solid[data[stop : min(stop + SLICE_BYTES, text)]])
                    stop = stop + int(gaps[0]) + 1 if len(gaps) else min(stop + SLICE_BYTES, text)
                end = stop if solid[data[stop - 1]] else stop - 1
                found.append((np.array([start]), np.array([end]), np.array([_long_hash(data[start:end])])))
                start = end
                continue
            stop = end
        part = data[start:stop]
        inner = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, side="right")] - start
        starts, ends = runs(solid[part], inner)
        found.append((starts + start, ends + start, span_hash(prefix_hash(part), starts, ends)))
        start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true values, also cut at the offsets in breaks."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def tally(data: np.ndarray, offsets: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """How many bytes of each text are true in `counted`, a segment of SLICE_BYTES at a time."""
    total = np.zeros(len(offsets) - 1, np.int64)
    for start in range(0, len(data), SLICE_BYTES):
        found = np.flatnonzero(counted[data[start : start + SLICE_BYTES]])
        total += np.diff(np.searchsorted(found, offsets - start))
    return total


def gram_hashes(words: np.ndarray, first: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words in each text, and how many each text has.

    words: hashes of all words; first, counts: each text's first word and number of
    words. A text with fewer words than `size`, but one at least, has one run of all.
    """
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(many)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for start in range(0, len(out), GRAMS):
        gram = np.arange(start, min(start + GRAMS, len(out)))
        text = np.searchsorted(ends, gram, side="right")
        at = first[text] + gram - (ends - many)[text]
        last = (first + counts)[text]
        total = np.zeros(len(gram), np.uint64)
        for k in range(size):
            place = at + k
            word = np.where(place < last, words[np.minimum(place, len(words) - 1)], np.uint64(k + 1))
            total = total * np.uint64(0xD6E8FEB86659FD93) + word
        out[start : start + len(gram)] = mixed(total)
    return out, many


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count-1 for each count, joined."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
