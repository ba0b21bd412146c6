"""Shared pieces of the training-data operators: storage, batches, word spans and hashes.

Texts are handled as flat UTF-8 byte arrays, so that splitting and hashing are
vectorised and no Python object is made for each word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of rows that go to Python at once (a larger row makes a batch of its own), unless the session has a setting.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; only local mode has a default."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return "file:///tmp/checkpoints"


def trim() -> None:
    """Gives the memory that this process holds unused back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trim_jvm(spark: SparkSession) -> None:
    """trim() for the driver's JVM, whose many planning threads hold freed native memory; nothing where it lacks the command."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):
        own, string = jvm.java.lang.Object, jvm.java.lang.String
        # through the interface, as the server's class itself isn't exported
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        values = gateway.new_array(own, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = gateway.new_array(own, 0), gateway.new_array(string, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def free() -> None:
    """trim() once cycles are gone: for the driver, after it has sent a model."""
    gc.collect()
    trim()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for the tasks of mapInArrow; a worker that waits for its next task then holds no memory of the last one."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run for a group of applyInArrow; what it held is given back when it has returned."""

    def go(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            trim()

    return go


def tidy_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """tidy_group() for two groups."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            trim()

    return go


_open: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables that staged() writes inside are removed at the end, but those written by the function that it gives.

    What leaves the block must therefore be such a kept table, or be read by nothing later.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    outer = _open[-1] if _open else None
    _open.append(folder)

    def kept(df: DataFrame, name: str, small: bool = False) -> DataFrame:
        return _write(df, f"{outer if outer else shared_dir(spark)}/{name}-{uuid.uuid4().hex}", small)

    try:
        yield kept
    finally:
        _open.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark then removes the shuffle files of a query as it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, small: bool = False) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    try:
        if small:
            spark.conf.set(_CLEANUP, "true")
        (df.write.option("compression", "zstd") if small else df.write).parquet(path)
    finally:
        if small:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    trim_jvm(spark)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; inside scratch() it goes with the rest.

    small: takes less disk, as zstd and without the shuffle files that the write made.
    """
    return _write(df, f"{_open[-1] if _open else shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", small)


#: Bytes of input, as Spark estimates them, that one shard of packed arrays is made of at most.
SHARD_BYTES = 64 << 20


def shards(spark: SparkSession, df: DataFrame | None = None) -> int:
    """How many hash shards packed arrays are dealt to: as many as shuffles have partitions, and more for a large df."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is None:
        return n
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size >> 60 else max(n, min(-(-size // SHARD_BYTES), 1 << 20))  # Spark takes what it can't estimate for very large


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has max_rows at most; else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows up to which what is to be dropped is broadcast.
DROP_ROWS = 1 << 20


def without(docs: DataFrame, bad: DataFrame, key: Column, digest: Column) -> DataFrame:
    """docs without the rows whose key (null too) and digest are in bad (key, digest); rows that share a key go each for themselves."""
    bad = bounded_broadcast(bad, DROP_ROWS)
    return docs.join(bad, key.eqNullSafe(bad["key"]) & (digest == bad["digest"]), "left_anti")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null reads as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; each holds one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Byte maps: lower-case A-Z; separators of the two word kinds.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_M = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
#: Keeps the first n bytes of a little-endian 64-bit word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG_SPAN = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each document's first word (n + 1); off starts at 0."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span.

    Eight bytes at a time are one number, which a bijective mixer spreads, so no two
    spans of up to eight bytes of one size collide. Longer ones chain the mixer over
    their parts, those of more than _LONG_SPAN bytes are hashed by xxh3.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    sizes = ends - starts
    h = mix((eight[starts] & _KEEP[np.minimum(sizes, 8)]) + _M[0])
    more = np.flatnonzero((sizes > 8) & (sizes <= _LONG_SPAN))
    for at in range(8, _LONG_SPAN, 8):
        if not len(more):
            break
        part = eight[starts[more] + at] & _KEEP[np.minimum(sizes[more] - at, 8)]
        h[more] = mix((h[more] * _M[1] + np.uint64(at)) ^ mix(part + _M[2]))
        more = more[sizes[more] > at + 8]
    if (far := np.flatnonzero(sizes > _LONG_SPAN)).size:
        raw = data.tobytes()
        h[far] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return mix(h ^ (sizes.astype(np.uint64) * _M[7]))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k following words; of fewer words, the whole sequence is the one shingle."""
    n = len(words)
    if not n:
        return words
    m = n - k + 1 if n >= k else 1
    h = np.full(m, min(n, k), np.uint64) * _M[6]
    for i in range(min(n, k)):
        h += mix(words[i : i + m] + _M[i % 6]) * (_M[i % 6] + np.uint64(2 * i))
    return mix(h)


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as byte planes of their differences, which shuffles compress well."""
    if not len(sorted_keys):
        return b""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, :width] = planes.T
    return np.cumsum(full.reshape(-1).view("<u8"), dtype=np.uint64)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts (1 each if not given)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts.astype(np.int64), first)
    return keys[first], total


def shard_bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where the n equal ranges of 64-bit keys begin in sorted_keys (n + 1)."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(np.int64)


def rows(schema: pa.Schema, *columns: list | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
