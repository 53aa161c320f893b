"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, and so share the machine's folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where that is unset: a temporary folder of a local master, an error of any other."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return there or tempfile.gettempdir()


def folder(spark: SparkSession, label: str) -> str:
    """A new path for one table."""
    return f"{shared(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, written once and read back: later uses see the same rows, and lost executors cost nothing."""
    at = folder(df.sparkSession, label)
    df.write.parquet(at)
    note(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within this block, tables that are written hand texts to Python in Arrow batches of ``rows`` rows at most (the default is 10,000).

    A batch exists several times over: as vectors and socket buffers in the JVM, outside of its heap, and as a copy and objects in
    Python. With long texts, batches of the default size are what fills an executor. The session's own setting comes back after.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Paths of the tables written in the innermost open block of ``cleared``. Threads don't see each other's.
_open: ContextVar[list[str] | None] = ContextVar("written tables", default=None)


def note(path: str) -> None:
    """Remember a written table for the block of ``cleared`` that it is written in, if there is one."""
    if (tables := _open.get()) is not None:
        tables.append(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of this block, the tables that were written in it: for work whose own result is written inside it.

    That holds for a block that fails too. Tables of other threads, which may be at work in blocks of their own, stay.
    """
    tables: list[str] = []
    before = _open.set(tables)
    try:
        yield
    finally:
        _open.reset(before)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
