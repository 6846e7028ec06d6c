"""Shared helpers of the corpus operators: stored intermediates, sizes, Arrow text access, word hashes."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager
from functools import lru_cache
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"

#: While a table is stored: the job's shuffle files go with it, and batches for Python stay small.
_WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_local_dir: dict[str, str] = {}
_storing: dict[int, int] = {}
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master (tests) may leave it unset."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: intermediates need a folder that all executors share")
    if "dir" not in _local_dir:
        _local_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="corpusmem-")
    return _local_dir["dir"]


@contextmanager
def _while_stored(spark: SparkSession):
    """Holds the settings above for as long as a thread of this session stores a table, and then restores them."""
    key = id(spark._jsparkSession)
    with _lock:
        if not _storing.get(key):
            _before[key] = {k: spark.conf.get(k, None) for k in _WHILE_STORED}
            for k, v in _WHILE_STORED.items():
                spark.conf.set(k, v)
        _storing[key] = _storing.get(key, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _storing[key] -= 1
            if not _storing[key]:
                for k, v in _before.pop(key).items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_before: dict[int, dict[str, str | None]] = {}


def small_batches(spark: SparkSession) -> None:
    """Batches of 1,000 rows for Python from here on, where the session has no number of its own: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, _WHILE_STORED[name])


class Work:
    """The tables that one call of an operator writes in the shared folder: Parquet, so lineage ends there and a lost
    executor loses nothing. clear() removes them once the operator has stored what its result needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/t-{uuid.uuid4().hex}"
        with _while_stored(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


def stored(df: DataFrame) -> DataFrame:
    """One table of a Work that is left in the shared folder, as a result reads it."""
    return Work(df.sparkSession).store(df)


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that hands freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def lean(f):
    """A function of Arrow batches or of a group that hands freed memory back when done: Python workers live on."""

    def free() -> None:
        pa.default_memory_pool().release_unused()
        _trim()(0)

    def whole(*args):
        try:
            return f(*args)
        finally:
            free()

    def each(batches):
        try:
            yield from f(batches)
        finally:
            free()

    if isgeneratorfunction(f):
        return each
    # Spark counts the parameters of a group's function
    return (lambda a: whole(a), lambda a, b: whole(a, b), lambda a, b, c: whole(a, b, c))[len(signature(f).parameters) - 1]


def extended(schema: T.StructType, **more: str | T.DataType) -> T.StructType:
    """A schema with further columns, name=type."""
    kind = lambda v: v if isinstance(v, T.DataType) else T._parse_datatype_string(v)
    return T.StructType([*schema.fields, *[T.StructField(k, kind(v)) for k, v in more.items()]])


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).first()[0]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (bytes, offsets), without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bufs = column.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, limit: int = 1_000_000):
    """Row ranges of at most `limit` bytes of text each (one row at least), so that a batch needs bounded memory."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


#: Words beyond so many bytes are hashed by a digest: sums of powers modulo 2 ** 64 meet for long patterned strings.
LONG_WORD = 64
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, _MULT, np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(n, _INV, np.uint64))])
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, int(n).bit_length()))
    return up[: n + 1], down[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of powers spread over all bits."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)  # in place from here on
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def power_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, by powers: what the hashes of ranges and runs are made of."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_TABLE[data], powers(len(data))[0][:-1], out=sums[1:])
    return np.cumsum(sums, out=sums)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal bytes give equal hashes wherever they stand. For short ranges.
    sums: of power_sums(data), if known."""
    sums = power_sums(data) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(np.uint64))


def gram_hashes(data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of all runs of `size` bytes."""
    sums = power_sums(data) if sums is None else sums
    out = sums[size:] - sums[: len(sums) - size]
    out *= powers(len(data))[1][: len(out)]
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a run of documents (A-Z as a-z), and for each document the range of its words."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[:-1]] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    bounds = np.searchsorted(starts, offsets)
    hashes = range_hashes(low, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = np.frombuffer(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return hashes, bounds[:-1], bounds[1:]


def shingles(hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """Hashes of the runs of `size` words; with fewer words the whole sequence is one run, without words there is none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, _U(width), np.uint64)
    for k in range(width):
        out = mix(out * _U(0x9DDFEA08EB382D69) + hashes[k : n - width + 1 + k])
    return out
