"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that Python code handles at once; long texts are cut further by bytes.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
#: The option of glibc's ``mallopt`` from which size on an allocation is the system's own.
MMAP_THRESHOLD = -3
#: Bytes of the batches in which Spark hands rows to Python, but for a single longer row.
ARROW_BYTES, ARROW_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, in the folder the cluster names for them.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, as in tests, the folder
    lies beside the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lost executors lose none of it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing still to be computed reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by bytes, not rows alone; a setting of the session's own stays."""
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, ARROW_BYTES)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bound on rows and, but for a single longer text, on bytes of ``text``."""
    start = 0
    while start < batch.num_rows:
        rows = min(BATCH_ROWS, batch.num_rows - start)
        while rows > 1 and batch.column(text).slice(start, rows).nbytes > BATCH_BYTES:
            rows //= 2
        yield batch.slice(start, rows)
        start += rows


def tidied(function):
    """For functions over Arrow batches: free memory goes back to the system, large arrays at once.

    Python workers stay for later tasks, beside a JVM that wants all of its heap.
    """

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(MMAP_THRESHOLD, 1 << 20)
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def one_thread() -> None:
    """Spark has a task on every core already; libraries must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
