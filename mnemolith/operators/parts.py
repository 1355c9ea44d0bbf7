"""Message parts: turns taken apart into text and tool outputs, and messages put together from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as fx

PART = "struct<part_type string, content string, tool_name string, tool_call_id string, tool_state string>"


def parts_of(turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part_index, part_id, part_type, content, tool_name, tool_call_id, tool_state, compacted_at) of turns with a text and an optional array of parts.

    A turn without parts is one part of its text; a part without a type is text.
    """
    single = F.array(F.struct(F.lit("text").alias("part_type"), F.coalesce("text", F.lit("")).alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("tool_name", "tool_call_id", "tool_state")]))
    own = F.when(F.size(F.coalesce("parts", F.array().cast(f"array<{PART}>"))) > 0, F.col("parts")) if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    rows = turns.select(*keys, F.posexplode(F.coalesce(own, single)).alias("part_index", "_p"))
    rows = rows.select(*keys, F.col("part_index").cast("long").alias("part_index"), F.coalesce("_p.part_type", F.lit("text")).alias("part_type"), F.coalesce("_p.content", F.lit("")).alias("content"), "_p.tool_name", "_p.tool_call_id", "_p.tool_state")
    return rows.withColumn("part_id", fx.stable_id("part_", *keys, "part_index")).withColumn("compacted_at", F.lit(None).cast("double"))


def rendered(part=None):
    """A part as text: a tool output under its tool's name, or a note in its place once it is compacted."""
    name = F.coalesce("tool_name", F.lit("tool"))
    note = F.concat(F.lit("[Tool output compacted: "), name, F.lit("; original part_id="), F.col("part_id"), F.lit("]"))
    return F.when(F.col("part_type") != "tool", F.col("content")).when(F.col("compacted_at").isNotNull(), note).otherwise(F.concat(F.lit("[Tool "), name, F.lit("]\n"), F.col("content")))


def message_texts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, searchable): the parts of each message in order, rendered, without empty ones; and their bare contents."""
    rows = parts.select(*keys, F.struct("part_index", rendered().alias("t"), F.col("content").alias("c")).alias("_p"))
    join = lambda f: F.array_join(F.filter(F.transform(F.col("_all"), lambda x: x[f]), lambda x: x != ""), "\n")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_all")).select(*keys, join("t").alias("text"), join("c").alias("searchable"))


def message_lists(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts): the parts of each message as one array in order."""
    cols = [c for c in parts.columns if c not in keys and c != "part_index"]
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part_index", *cols))).alias("parts"))


def hydrated(messages: DataFrame, parts: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with their parts' contents fetched from a content store (content_hash, content): parts hold hashes only."""
    return messages.join(parts, keys).join(store.select("content_hash", "content"), "content_hash")
