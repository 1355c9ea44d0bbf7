"""The supplied tables as the engine's inputs: messages, documents, vectors, events and long-term items."""

from __future__ import annotations

import contextlib
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolith.functions import text as fx

MESSAGES = T.StructType([T.StructField(n, t) for n, t in (("session_id", T.LongType()), ("turn", T.LongType()), ("position", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("tokens", T.LongType()))])


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out by its first column if it comes in fewer splits than there are cores: a small file in one row group would keep one of them busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """Where derived tables are kept: the folder that all executors share, else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextlib.contextmanager
def no_shuffle_files_left(spark: SparkSession):
    """The shuffle files of what runs inside go when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that all executors share; the shuffle files behind it go at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with no_shuffle_files_left(spark):
        return df.checkpoint(eager=True)


def derived(spark: SparkSession, name: str, source: DataFrame, build) -> str:
    """The folder of a table derived from the files of a source, written by build(folder) where it isn't there yet.

    Its name tells the files by path, size and time, so a changed source is derived anew. It is written beside its place and
    renamed, so no reader sees a part of it; it is deleted when the driver ends.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    seen = []
    for f in sorted(source.inputFiles()):
        at = hadoop.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    folder = f"{shared_folder(spark)}/derived-{name}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()[:16]}"
    place, part = hadoop.Path(folder), hadoop.Path(f"{folder}.{uuid.uuid4().hex}")
    fs = place.getFileSystem(conf)
    if not fs.exists(place):
        build(part.toString())
        if not fs.rename(part, place):
            fs.delete(part, True)  # another writer was first
        fs.deleteOnExit(place)
    return folder


def messages(conversations: DataFrame) -> DataFrame:
    """(session_id, turn, position, role, text, tokens) of conversation turns; positions start at 1."""
    return conversations.select(F.col("conv_id").alias("session_id"), "turn", (F.col("turn") + 1).alias("position"), "role", "text", fx.tokens("text").alias("tokens"))


def parts(msgs: DataFrame) -> DataFrame:
    """Message parts: a system turn stands for the output of a finished tool, other turns for text."""
    return msgs.withColumns({"part_type": F.when(F.col("role") == "system", "tool").otherwise("text"), "tool_state": F.when(F.col("role") == "system", "completed"), "is_protected": F.lit(False), "compacted": F.lit(False), "is_summary": F.lit(False)})


def hook_events(events: DataFrame) -> DataFrame:
    """Events as hooks of a session per user: prompt, tool, stop or discard."""
    kind = F.when(F.col("event_type") == "signup", "prompt").when(F.col("event_type").isin("view", "click"), "tool").when(F.col("event_type") == "purchase", "stop").when(F.col("event_type") == "error", "discard").otherwise("other")
    return events.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), "value", "props")


def long_term_items(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as long-term items, with confidence and controller flags from their labels."""
    lab = labels.select("doc_id", "quality", "toxic")
    confidence = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    return documents.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 10 == 0, "correction").when(F.col("doc_id") % 10 == 1, "contradiction").otherwise("rlm_chunk").alias("source_type"), F.col("source").alias("agent_id"), confidence.alias("confidence"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("controller_ignored"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1).alias("superseded_by"), F.when(F.col("doc_id") % 7 == 1, F.col("doc_id") - 1).alias("supersedes"), (F.col("doc_id") * 10).alias("indexed_at"), "text"
    )
