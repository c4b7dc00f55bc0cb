"""What the text operators share: tables, the shared folder, and vectorised words and hashes over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step takes at most, unless one text is longer.
STEP_BYTES = 1 << 20

_U = np.uint64

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


#: Bytes of an Arrow batch between Spark and a worker, so that long rows don't make large batches.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a DataFrame. The session's Arrow batches are bounded from now on, unless it has a bound of its own."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset on one machine (as in tests) below a temporary folder. On
    a cluster it must be set, as executors and driver share no other folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="terrane-"))
        root = _own_dir[0]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives a lost executor."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    # The shuffles behind a written table are of no more use: their files go when it is written.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the strings of a column hold about `most` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _offsets(array: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if large else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(len(array) + 1, np.int64), None
    return np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64), data


def lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each string; 0 for null."""
    at, _ = _offsets(array)
    size = np.diff(at)
    if array.null_count:
        size = np.where(np.asarray(array.is_valid()), size, 0)
    return size


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings end to end, and len + 1 offsets into them; null is empty."""
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    at, data = _offsets(array)
    if data is None:
        return np.zeros(0, np.uint8), at
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        _powers[:] = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, _U)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers.append(p)
        if size > 8 * STEP_BYTES:  # of one huge text: not kept
            big = _powers[0], _powers[1]
            _powers[:] = []
            return big
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P of values[i] * B**i, and the powers of 1/B: the hash of values[s:e] is (P[e] - P[s]) / B**s."""
    power, inverse = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return sums, inverse


#: Bytes of a span that are hashed in numpy, eight at a time; longer spans are few and go through xxhash.
_SHORT = 64


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair; data: bytes. No sums of powers: every eight bytes are mixed into
    what came before, so that regular words don't collide. Hashes of different seeds are independent."""
    size = end - start
    out = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(2 * seed + 1))
    if not len(size):
        return out
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    for done in range(0, _SHORT, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        eight = wide[start[live] + done].view(_U).ravel()
        spare = (np.maximum(8 - (size[live] - done), 0) * 8).astype(_U)
        out[live] = mix(out[live] ^ mix((eight << spare) + _U(0xD6E8FEB86659FD93)))
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        out[long] = [xxhash.xxh3_64_intdigest(data[s:e].tobytes(), seed) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def rolling_hash(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive values; values: bytes or 64-bit."""
    if len(values) < k:
        return np.zeros(0, _U)
    if values.dtype == np.uint8:
        values = _BYTE[values]
    sums, inverse = prefix(values)
    return mix((sums[k:] - sums[:-k]) * inverse[: len(values) - k + 1] + _U(k))


#: Kinds of bytes: 0 stands between words.
SPACED = np.ones(256, np.uint8)
SPACED[[0x20, *range(0x09, 0x0E)]] = 0


class Words:
    """The words of a batch of texts: start and end in data, the document of each, and first[d]:first[d + 1] as its range.

    A word is a run of bytes of one kind but 0 inside one text.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, kinds: np.ndarray = SPACED):
        kind = np.zeros(len(data) + 1, np.uint8)
        kind[:-1] = kinds[data]
        change = np.ones(len(data) + 1, bool)
        change[1:] = kind[1:] != kind[:-1]
        change[at] = True
        first = change[:-1] & (kind[:-1] > 0)
        last = change[1:] & (kind[:-1] > 0)
        self.data, self.at = data, at
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end, seed)

    def grams(self, k: int, word_hash: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the index of each run's first word."""
        h = rolling_hash(self.hashes() if word_hash is None else word_hash, k)
        inside = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        return h[inside], inside


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return h.view(np.int64)


def records(names: list[str], columns: list, types: list[pa.DataType] | None = None) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=types[i] if types else None) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
