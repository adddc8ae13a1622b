"""What the operators share: the shared folder, memory of workers, hashing of byte spans, packing of batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
NULL_ID = np.iinfo(np.int64).max  # a null doc_id comes after every other


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir. Where that is unset, a local session gets a folder of this
    machine, which goes when the process ends; on a cluster executors could not see it, so that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="tandem-")
            atexit.register(shutil.rmtree, folder, True)
            folder = f"file://{folder}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{context.applicationId}"


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_in = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete what `stored` wrote, once nothing will read it again. What results depend on stays until `clear`."""
    for table in tables:
        if table is not None:
            delete_path(table.sparkSession, table.stored_in)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; frames that read it are of no use then."""
    delete_path(spark, shared_dir(spark))


def integral(df: DataFrame, name: str) -> None:
    """ValueError unless the column holds whole numbers: ids of other types can't be compared by size."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"column '{name}' must hold whole numbers, it is {kind.simpleString()}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give free memory back to the system: workers live on between tasks, of this and of other queries."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves nothing behind in its worker when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is changed in place."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_C = ctypes.CDLL(None)
_tables: dict[int, np.ndarray] = {}  # of the running task


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64; kept until the task ends up to 2 MB of text."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, U64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 1 << 21:
            _tables[int(base)] = table
    return table[:n]


class SpanHash:
    """Hashes of any span of a byte array in constant time each, by prefix sums; the same for equal bytes anywhere."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64))

    def rolling(self, m: int) -> np.ndarray:
        """Of every span of m bytes, by its start."""
        return mix((self.sums[m:] - self.sums[:-m]) * self.back[: max(len(self.sums) - m, 0)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if rest := w - have:
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text each; a longer text is a part by itself."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    first = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts of an Arrow column joined, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if offsets is not None and n else np.zeros(n + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def binary_column(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The other way: an Arrow column from joined bytes and offsets."""
    large = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])
    return large.cast(pa.binary()).cast(kind) if kind == pa.string() else large.cast(kind)
