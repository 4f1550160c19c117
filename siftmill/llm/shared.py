"""Places and helpers that the operators of this subpackage share.

Everything that one stage writes and another reads goes to the folder named in
``spark.checkpoint.dir``, which the driver and all executors see.  Only where
the session leaves it unset (tests, notebooks) a folder of our own is made.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in ``[\x20\x09-\x0D]``; ``bytes.split`` and ``bytes.strip`` use the same set.
ASCII_WS = b" \t\n\x0b\x0c\r"

#: Small sides below this size are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="siftmill-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder (nothing is made yet)."""
    return f"{shared_root(spark)}/siftmill/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a written table: its lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes that a written table takes."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small_side(df: DataFrame, path: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a table written at ``path``: marked for broadcast only if its files are below ``limit``.

    Beyond it the join is an ordinary shuffle join, which adaptive execution splits where keys are hot.
    """
    return F.broadcast(df) if bytes_of(df.sparkSession, path) <= limit else df


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of stages whose results are written: nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Executors collect their garbage and give free heap back to the system, which they do not by themselves.

    One small task for each core, so that each executor has some.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


# ---- Arrow ---------------------------------------------------------------

#: Rows and bytes of a batch between Spark and Python: with texts of any length, a worker holds little at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: Called at a task's end: forgets what a worker remembers and a later task soon has again.
FORGET: list = []


def _give_back() -> None:
    """Free memory goes back to the system; workers live on for other stages."""
    for forget in FORGET:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` in small batches."""
    for key, value in BATCHES.items():
        df.sparkSession.conf.set(key, value)

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(bounded, schema)


def utf8_rows(column) -> list[memoryview]:
    """The UTF-8 bytes of each row without decoding; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [memoryview(b"")] * len(column)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data if data is not None else b"")
    return [view[a:b] for a, b in zip(at, at[1:])]


# ---- Files of numpy arrays in the shared folder --------------------------


def local_path(uri: str) -> str | None:
    """The path behind a ``file:`` URI; None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_array(uri: str, array: np.ndarray) -> None:
    """Write one ``.npy`` file; a second attempt of the same task replaces it whole."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            np.save(out, array)
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as out:
            np.save(out, array)


def map_array(uri: str) -> np.ndarray:
    """A ``.npy`` file of the shared folder, memory-mapped.

    Where the folder is no mounted path, the file is fetched into an unlinked temporary file first,
    so that nothing stays behind on the executor.
    """
    if path := local_path(uri):
        return np.load(path, mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile(suffix=".npy") as own, store.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            own.write(block)
        own.flush()
        return np.load(own.name, mmap_mode="r")
