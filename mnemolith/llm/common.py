"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WS_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; one in fewer splits than there are cores, a small file in one row group, is dealt out by its first column."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS_PATTERN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row, also when body's lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in spark.checkpoint.dir, or where that is missing one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return sc.getCheckpointDir()


def _at_end(spark: SparkSession, path: str) -> None:
    """Has a folder that is there deleted when the driver ends; until then results that aren't read yet may need it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


@contextmanager
def cleaning(spark: SparkSession):
    """While it lasts, an execution's shuffle files go when it ends; what is written to the shared folder doesn't need them, and else they would wait for the driver's heap to run short."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that all executors share."""
    _at_end(df.sparkSession, _shared_folder(df.sparkSession))
    with cleaning(df.sparkSession):
        return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a compressed table and read again; for intermediate results of some size."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*stored: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read any more."""
    for df in stored:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Gives memory that a finished task has freed back to the system, where the C library can; workers live on between stages."""
    import ctypes
    import ctypes.util

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(text: str, most: int):
    """Pieces of a text of about ``most`` code points, cut only before a space or newline."""
    at, n = 0, len(text)
    while n - at > most:
        end = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if end < 0:
            found = [x for x in (text.find(" ", at + most), text.find("\n", at + most)) if x >= 0]
            end = min(found) if found else n
        yield text[at:end]
        at = end
    if at < n or not n:
        yield text[at:]
