"""Helpers shared by the training-data operators: shared folders, row keys, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import posixpath
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a stored table that make a file of their own.
ROWS_A_FILE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, only a local master may fall back to a folder of this
    machine; a cluster without it is an error, because executors would write to their own disks.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return posixpath.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows at most in files of about ROWS_A_FILE, where the session's partitions would make smaller ones."""
    files = max(1, -(-rows // ROWS_A_FILE))
    return df.coalesce(files) if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, what: str, rows: int | None = None, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back (columnar, so wide rows stay small). rows: an upper bound, if known."""
    path = scratch(df.sparkSession, what)
    df = df if rows is None else gathered(df, rows)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables. Whatever was made of them must be stored itself, for nothing can read or recompute them afterwards."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(shared_dir(spark), files[0].split("/")[-2]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two non-null key columns ``_k`` and ``_c`` (96 bits) that stand for (id, text).

    They make joins back to the documents safe for null ids and for an id that repeats with
    another text; rows that repeat both share a key and therefore a result.
    """
    both = F.concat_ws("\x00", docs[doc_id].cast("string"), docs[text])
    return [F.xxhash64(docs[doc_id], docs[text]).alias("_k"), F.crc32(both.cast("binary")).alias("_c")]


def tidy(run):
    """An Arrow map that gives its memory back at the end of a task; Python workers live on, and idle ones would keep it."""

    @functools.wraps(run)
    def mapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return mapped


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Jobs started inside have these settings of the session (dots written as two underscores); those before are put back."""
    names = {n: n.replace("__", ".") for n in values}
    before = {n: spark.conf.get(name) for n, name in names.items()}
    try:
        for n, name in names.items():
            spark.conf.set(name, values[n])
        yield
    finally:
        for n, name in names.items():
            spark.conf.set(name, before[n])


def batches_up_to(spark: SparkSession, size: int):
    """Jobs started inside send batches of so many bytes, or one row, to Python; the session's setting is put back."""
    return settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(size))


def texts(batch: pa.RecordBatch, column: str = "text", rows: int = 256):
    """Small slices of a batch with their texts (null: empty), so that no task holds many words at once."""
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
