"""Shared helpers of the training-data operators: scratch folders, Arrow text blocks."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that numpy code works on at once; a longer single text is a block of its own.
BLOCK_BYTES = 4 << 20
#: The same where numpy holds many numbers for each byte.
SMALL_BYTES = 1 << 20

#: glibc's; other C libraries may have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_own_base: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_base:
        path = tempfile.mkdtemp(prefix="recollect-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_base.append(f"file://{path}")
    return _own_base[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. A URI is returned so that every executor resolves it alike."""
    base = scratch_base(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, least: int) -> DataFrame:
    """df in no more partitions than give each task `least` rows; small tables don't need hundreds of tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // least)))


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored() frames (and their unions) that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def unclashed(names: list[str], taken: list[str], suffix: str = "_in") -> list[str]:
    """names, with the suffix as often as it takes to be unlike those taken and one another."""
    out: list[str] = []
    for n in names:
        while n in taken or n in out or (n.endswith(suffix) and n in names and names.index(n) != len(out)):
            n += suffix
        out.append(n)
    return out


def as_text(column: pa.Array) -> pa.Array:
    """Null texts become empty ones."""
    return column.fill_null("") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one more entry than texts); null is empty."""
    column = as_text(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def give_back() -> None:
    """Hand memory that Arrow and the allocator hold for later back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most `limit` bytes of text or else a single row; at the end memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = max(at + 1, min(end, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end
    give_back()
