"""What the corpus operators share: byte-level text views, hashing, and shared scratch space.

The Python operators read texts as Arrow buffers and work on flat ``uint8`` arrays, a bounded slice
of whole documents at a time, so that no step loops over characters.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
SLICE_BYTES = 1 << 19
#: Rows and bytes handed to Python at a time.
BATCH_ROWS, BATCH_BYTES = 4000, 2 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; outside a cluster a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Hand rows to Python in batches smaller than Spark's defaults, unless the session has its own numbers.

    Both sides hold a batch whole, the JVM outside its heap. Operators that use Python call this for the session of their
    documents, as Spark has no other place for it.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", f"{size}b")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


class Shared:
    """A batch function made on the executor from a broadcast value."""

    def __init__(self, shared, make: Callable) -> None:
        self.shared, self.make = shared, make

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.make(self.shared.value)(batches)


def as_text(column: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# --- texts as bytes -------------------------------------------------------------------------


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values joined, and the n + 1 offsets between them; null is empty."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return what earlier tasks of this worker freed to the system: workers are used again and again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole documents in steps of about ``limit`` bytes: (rows, their bytes, offsets)."""
    give_back()
    for batch in batches:
        data, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < len(offsets) - 1:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high
    give_back()


@functools.cache
def lower_table() -> np.ndarray:
    """Byte to byte: A-Z to a-z, all others unchanged."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


@functools.cache
def space_words() -> np.ndarray:
    """Which bytes are in words `[^\\x20\\x09-\\x0D]+`."""
    out = np.ones(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


@functools.cache
def letter_words() -> np.ndarray:
    """Which bytes are in words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def squeeze(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document, joined by one space.

    Returns the joined bytes, each word's start and end in them, and the n + 1 positions of the
    documents in the list of words.
    """
    inside = members[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    own = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[own] = inside[own]
    last[own[own > 0] - 1] = inside[own[own > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    places = np.cumsum(keep) - 1
    joined = np.where(inside, data, np.uint8(32))[keep]
    return joined, places[starts], places[ends] + 1, np.searchsorted(starts, offsets)


# --- hashes ---------------------------------------------------------------------------------

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for which, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(max(size, SLICE_BYTES + 4096), base, np.uint64)
            steps[0] = 1
            _powers[which] = np.multiply.accumulate(steps)
    return _powers


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_240_607)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all 64; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any byte ranges of an array, in constant time each."""

    def __init__(self, data: np.ndarray) -> None:
        power, self._inverse = _grown(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * power[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of one width, by start."""
        n = max(0, len(self._sums) - width)
        return mix((self._sums[width : width + n] - self._sums[:n]) * self._inverse[:n] + np.uint64(width))


def run_numbers(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs whose lengths are given."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def lookup(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted array ``among``, -1 where it is absent."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)
