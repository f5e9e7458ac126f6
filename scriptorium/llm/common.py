"""Shared helpers: scratch space on the cluster's shared folder, and vectorised word hashing.

Words are runs of bytes other than space and 0x09-0x0D; every separator is
ASCII, so words can be found in UTF-8 bytes without decoding.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from ..session import ship_package

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Masks that keep the first n bytes of a little-endian 8-byte load.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the table stands for its shuffle files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Stashed tables of one operator, deleted together once its result is stored."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stash(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        forget(*self.tables)
        self.tables = []


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that go to Python workers (rows; long texts also by bytes)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def free_prefix(columns: list[str], start: str) -> str:
    """A prefix with which none of the columns begins."""
    prefix = f"_{start}_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def document_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def lean(run: Callable) -> Callable:
    """The same function over batches; what it has freed goes back to the system, as workers are used again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def _recoded(df: DataFrame, column: str, kind: DataType, coder) -> DataFrame:
    names = df.columns
    at = names.index(column)
    schema = StructType([StructField(f.name, kind) if k == at else f for k, f in enumerate(df.schema.fields)])
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder()
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([None if x is None else code(x) for x in columns[at].to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(lean(run), schema)


def packed(df: DataFrame, column: str) -> DataFrame:
    """The same rows, a text column as Zstandard bytes: for shuffles that must move whole texts."""
    return _recoded(df, column, BinaryType(), lambda: (lambda compress: lambda x: compress(x.encode()))(zstandard.ZstdCompressor(level=1).compress))


def unpacked(df: DataFrame, column: str) -> DataFrame:
    return _recoded(df, column, StringType(), lambda: (lambda plain: lambda x: plain(x).decode())(zstandard.ZstdDecompressor().decompress))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes of text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    loads = np.ndarray(n + 1, "<u8", padded.data, strides=(1,))
    lengths = ends - starts
    h = np.full(len(starts), _M1)
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - at
        chunk = loads[starts[live] + at] & _FIRST[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ chunk) * _M1 + np.uint64(at + 1))
        live, at = live[left > 8], at + 8
    h = mix(h + lengths.astype(np.uint64) * _M1)
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each document the hashes of its `size`-word shingles in order; a shorter one has its whole sequence as one."""
    count = max(0, len(words) - size + 1)
    rolled = words[:count].copy()
    for k in range(1, size):
        rolled = rolled * _M3 + words[k : k + count]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(rolled[a : b - size + 1])
        elif b > a:
            h = words[a : a + 1].copy()
            for k in range(a + 1, b):
                h = h * _M2 + words[k : k + 1]
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
