"""Words, hashes, packed integers and stored tables that the operators of this package share."""
from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.session import checkpoint_dir

#: Distinct words whose hashes one worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED_WORDS = 100_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Spark deletes an action's own shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch where rows carry whole texts: buffers on both sides of a Python worker stay small.
TEXT_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python in batches of at most ``TEXT_ROWS`` rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > TEXT_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(TEXT_ROWS))
    return df


def _release() -> None:
    """Give freed memory back to the system: Spark's Python workers live on after a task, for other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that gives back its memory when its partition ends."""
    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()
    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for a function over one group's table."""
    @functools.wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _release()
    return tidied


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: names of an operator cannot clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder, read back: several readers do
    not recompute it, and a lost executor does not lose it. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def crc_rest(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then split at space, tab, LF, VT, FF and CR only."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64), different for each seed."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Odd multipliers that make a word's place count in the hash of a sequence.
PLACES = mix(np.arange(64, dtype=np.uint64), 7) | np.uint64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, in order; runs of different k never share a rule."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j:j + n] * PLACES[j]
    return mix(out, k)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct integers. Sorting is many times quicker here than the hash table of ``np.unique``."""
    v = np.sort(values)
    first = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=first[1:])
    return v[first]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the planes that are all zero."""
    v = np.ascontiguousarray(values, np.uint64)
    top = int(v.max()) if len(v) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as differences."""
    v = np.asarray(values, np.uint64)
    return pack(np.diff(v, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(values):
        return []
    cut = (np.nonzero(values[1:] != values[:-1])[0] + 1).tolist()
    return list(zip([0, *cut], [*cut, len(values)], strict=True))
