"""Scratch tables, Arrow batch limits and the vectorised word splitter that the operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; arrays of 8 bytes a character stay near 20 MB each.
BLOCK = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir; a folder of our own only where that is unset and all is one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


_made: list[str] = []


def _located(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends, or with the `passing` block it is made in."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    store, where = _located(spark, path)
    store.deleteOnExit(where)
    _made.append(path)
    return path


@contextmanager
def passing(spark: SparkSession):
    """Scratch tables made inside the block are deleted at its end: what is read later must be written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            store, where = _located(spark, path)
            store.delete(where, True)
        del _made[before:]


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and lost executors cost no rework."""
    spark = df.sparkSession
    path = path or scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession) -> None:
    """Smaller batches than Spark's 10,000 rows, so that long texts fit in a Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


_tidied = [float("-inf")]
#: Percent of the driver's heap that may stay free after a collection; Java's own 70 keeps three times what lives.
HEAP_FREE = 30


def _manage(spark: SparkSession, bean: str, what: str, *values: str) -> bool:
    """Call an operation of one of the driver JVM's management beans; False where this JVM has none of the name."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    given, kinds = array(lang.Object, len(values)), array(lang.String, len(values))
    for k, x in enumerate(values):
        given[k], kinds[k] = x, "java.lang.String"
    args = array(lang.Object, 4)
    try:
        args[0], args[1], args[2], args[3] = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), what, given, kinds
        # The server's class is not exported, its interface is.
        call = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def tidy(spark: SparkSession, pause: float = 1.5) -> bool:
    """Collect what finished queries left in the driver (plans, broadcasts, generated classes) and give it back to the
    system, unless that was done under `pause` seconds ago: a driver that runs many queries fills its heap to the limit
    and keeps what its threads freed otherwise."""
    if time.monotonic() - _tidied[0] < pause:
        return False
    for end, percent in (("Min", HEAP_FREE // 2), ("Max", HEAP_FREE)):
        _manage(spark, "HotSpotDiagnostic", "setVMOption", f"{end}HeapFreeRatio", str(percent))
    spark.sparkContext._jvm.java.lang.System.gc()
    _manage(spark, "DiagnosticCommand", "systemTrimNativeHeap")
    release()
    _tidied[0] = time.monotonic()
    return True


def release() -> None:
    """Give freed memory back to the system: a reused worker process would keep a task's peak otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library keeps what it keeps


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    release()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each row in them; null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, 256, dtype=np.uint64), None


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n positions at least."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of lower-cased (A-Z) texts: 64-bit hashes, byte spans and offsets by row."""

    def __init__(self, texts: pa.Array):
        data, self.rows = text_bytes(texts)
        self.raw = data
        n = len(data)
        gap = _SPACE[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        cut = self.rows[:-1][self.rows[:-1] < n]
        begins[cut] = ~gap[cut]
        ends = ~gap
        ends[:-1] &= gap[1:]
        cut = self.rows[1:][self.rows[1:] > 0] - 1
        ends[cut] = ~gap[cut]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.starts, self.rows)
        self.low = _LOWER[data]
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        first = 0
        letters = _tables()[0]
        while first < len(out):
            begin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + BLOCK, "right")))
            s, e = self.starts[first:last] - begin, self.ends[first:last] - begin
            size = int(e[-1])
            up, down = _power(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(letters[self.low[begin : begin + size]] * up[:size], out=sums[1:])
            out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            first = last
        return out

    def word(self, k: int) -> bytes:
        return self.low[self.starts[k] : self.ends[k]].tobytes()


def long_range(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - starts
