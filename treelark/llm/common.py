"""Shared pieces: tables, the shared folder, Arrow text access and vectorised hashing.

Conventions every operator follows: a null text is an empty text, a document without words has no windows,
a null ``doc_id`` is carried through, rows are told apart by ``doc_id`` together with a hash of their text, and
columns the operator doesn't need are never looked at, so their names can't clash.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in runs of documents of about so many bytes; a longer document is a run of its own.
RUN_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where that is unset and all runs on this machine, one of
    our own. Without it a cluster has none, and an error says so."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='treelark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        if not getattr(spark, "_treelark_shared", None):
            spark._treelark_shared = found
        found = spark._treelark_shared
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that nothing refers to any more; it learns of them when garbage is collected."""
    for _ in range(2):  # the first frees what Python still holds in the JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def row_key() -> Column:
    """Tells apart rows of one doc_id with different texts."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def trim() -> None:
    """Gives freed memory back to the system; a worker that is used again would keep it through other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column, without a copy."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, where, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def runs(offsets: np.ndarray, limit: int = RUN_BYTES):
    """Row ranges (first, end) of at most limit bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def deflated(rows: DataFrame) -> DataFrame:
    """rows(doc_id, rk, text) with the text as zstd-compressed UTF-8 in z: what is shuffled to meet marks is half as large."""

    def run(it):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in it:
            data, offsets = text_buffer(batch.column(2))
            raw, at = memoryview(data), offsets.tolist()
            packed = pa.array([pack(raw[x:y]) for x, y in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "rk", "z"])
            del packed
            trim()

    return rows.mapInArrow(run, "doc_id long, rk long, z binary")


def inflated(column: pa.Array, limit: int = RUN_BYTES):
    """Runs of rows of a column made by deflated(): first, end, bytes, offsets from 0."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts, size, first = [], 0, 0
    for k, packed in enumerate(column):
        parts.append(unpack(packed.as_buffer()))
        size += len(parts[-1])
        if size >= limit or k == len(column) - 1:
            yield first, k + 1, np.frombuffer(b"".join(parts), np.uint8), prefix(np.array([len(x) for x in parts], np.int64))
            parts, size, first = [], 0, k + 1


_MASK = (1 << 64) - 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); changes x in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans of more bytes are hashed one by one with BLAKE2b.
_LONG = 256
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LEFT = (_U(0xE7037ED1A0B428DB), _U(0xA0761D6478BD642F))
_HEADS = np.append((_U(1) << (_U(8) * np.arange(8, dtype=_U))) - _U(1), _U(_MASK))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix(values: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Running sums with a leading zero."""
    out = np.empty(len(values) + 1, dtype)
    out[0] = 0
    np.cumsum(values, out=out[1:], dtype=dtype)
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand.

    A chain over eight bytes at a time with a mixing that isn't linear in any arithmetic, so that no family of strings (as
    Thue-Morse words are for polynomials modulo 2**64) collides by its form. Tables 0 and 1 are two different hashes.
    """
    size = ends - starts
    h = size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(_SEEDS[table])
    if not len(size):
        return h
    eight = _eights(data)
    h ^= eight[starts] & _HEADS[np.minimum(size, 8)]
    mix(h)
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([table])).digest(), "little")
    rest, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(rest):
        h[rest] = mix(h[rest] ^ eight[np.minimum(starts[rest] + k, ends[rest] - 8)])
        k += 8
        rest = rest[size[rest] > k]
    return h


def join_hash(a: np.ndarray, b: np.ndarray, table: int = 0) -> np.ndarray:
    """The hash of two neighbours from theirs."""
    x = a * _LEFT[table]
    x += b
    return mix(x)


class Windows:
    """Hashes of runs of consecutive items (already mixed 64-bit values) from hashes of runs of 2, 4, 8... of them."""

    def __init__(self, items: np.ndarray, table: int = 0, first: int = 0):
        """first: items are hashes of runs of 2**first of the things that lengths count."""
        self.levels, self.table, self.first = [items], table, first

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k - self.first:
            x, w = self.levels[-1], 1 << (len(self.levels) - 1 + self.first)
            self.levels.append(join_hash(x[:-w], x[w:], self.table) if len(x) > w else x[:0])
        return self.levels[k - self.first]

    def every(self, n: int) -> np.ndarray:
        """Of all runs of n items."""
        k = n.bit_length() - 1
        x, by = self.level(k), n - (1 << k)
        return x.copy() if not by else join_hash(x[:-by], x[by:], self.table) if len(x) > by else x[:0].copy()

    def at(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the runs lo..hi - 1, none of them empty."""
        size = hi - lo
        k = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(size), _U)
        for d in np.unique(k).tolist():
            some = np.flatnonzero(k == d)
            both = self._of(d, np.concatenate([lo[some], hi[some] - (1 << d)]))
            out[some] = join_hash(both[: len(some)], both[len(some) :], self.table)
        return mix(out + size.astype(_U))

    def _of(self, k: int, at: np.ndarray) -> np.ndarray:
        """level(k)[at], without making a whole level for few places."""
        lack = k - self.first - len(self.levels) + 1
        if lack <= 0 or len(at) << lack > lack * len(self.levels[0]):
            return self.level(k)[at]
        both = self._of(k - 1, np.concatenate([at, at + (1 << (k - 1))]))
        return join_hash(both[: len(at)], both[len(at) :], self.table)


def byte_windows(data: np.ndarray, table: int = 0) -> Windows:
    """Windows over bytes, of eight or more."""
    return Windows(mix(_eights(data)[: max(0, len(data) - 7)] ^ _U(_SEEDS[table])), table, 3)


def gram_hash(items: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive items (already mixed 64-bit values)."""
    return Windows(items).every(n) if len(items) >= n else np.zeros(0, _U)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the rows' offsets among the words. offsets begin at 0."""
    n = len(data)
    is_word = ~_SPACES[data]
    first, last = is_word.copy(), is_word.copy()
    if n:
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        edges = offsets[:-1][offsets[1:] > offsets[:-1]]
        first[edges] = is_word[edges]
        edges = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[edges] = is_word[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def per_row(running: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums by row from running sums."""
    return running[offsets[1:]] - running[offsets[:-1]]


def twins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys by value; which of the ordered equal their predecessor; and, in the given order, which occur twice."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flag = np.zeros(len(keys), bool)
    if len(keys):
        flag[order[1:][same]] = True
        flag[order[:-1][same]] = True
    return order, same, flag


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where one of each stands, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], place


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in a run of length items from one of the (distinct) starts."""
    d = np.zeros(n + 1, np.int32)
    d[starts] += 1
    d[starts + length] -= 1
    return np.cumsum(d[:-1]) > 0
