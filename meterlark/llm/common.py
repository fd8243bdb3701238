"""Helpers that the training-data operators share.

Tables that must outlive an executor are written as Parquet to the folder that the cluster shares
(``spark.checkpoint.dir``) and read back, which also cuts lineage.  Text is handled as the bytes of Arrow buffers, in
slices of bounded size, so that a Python worker's memory doesn't follow the size of a partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes outside these six (space, and 0x09 to 0x0D).
SPACES = b" \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: Bytes of text that a task turns into arrays at a time (one longer document makes a slice of its own).
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where none is set and the master is local, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterlark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` has written for tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder_of_id(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes of text (or one row), with the bytes and offsets of their text."""
    for batch in batches:
        data, at = buffers(batch.column(text))
        row, rows = 0, batch.num_rows
        while row < rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            to = min(to, rows)
            yield batch.slice(row, to - row), data[at[row] : at[to]], at[row : to + 1] - at[row]
            row = to


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it is in; rows are bounds of words too."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    end = np.flatnonzero(~space & (after | first[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64; as many as a slice needs are kept for the next call, more are not."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + 2:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a sequence of 64-bit values (or bytes); equal spans have equal hashes, whatever stands around.

    Starts and ends ascend.  Spans are taken a slice at a time, so that memory doesn't follow the length of the sequence.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        part = values[lo:hi]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_BYTE[part] if part.dtype == np.uint8 else part) * powers(_BASE, len(part)), out=total[1:])
        a, b = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((total[b] - total[a]) * powers(_INVERSE, len(part) + 1)[a] + (b - a).astype(np.uint64))
        at = to
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    return span_hashes(data, start, end)
