"""Content-addressed storage and the writes on it, as transformations of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx


def content_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, first_id, reference_count, token_count): one row for each text, whoever holds it."""
    rows = docs.select(F.col(id_col).alias("_id"), fx.content_hash(text_col).alias("content_hash"), F.floor(F.char_length(text_col) / 4).cast("long").alias("_t"))
    return rows.groupBy("content_hash").agg(F.min("_id").alias("first_id"), F.count("*").alias("reference_count"), F.max("_t").alias("token_count"))


def dedup_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content_hash, is_new): whether a row is the first with its text, by id."""
    rows = docs.select(id_col, fx.content_hash(text_col).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min(id_col).alias("_first"))
    return rows.join(first, "content_hash").select(id_col, "content_hash", (F.col(id_col) == F.col("_first")).alias("is_new"))


def merge_store(store: DataFrame, new: DataFrame) -> DataFrame:
    """A store after more content: counts add up, first ids stay the least."""
    return store.unionByName(new).groupBy("content_hash").agg(F.min("first_id").alias("first_id"), F.sum("reference_count").alias("reference_count"), F.max("token_count").alias("token_count"))


def release(store: DataFrame, released: DataFrame) -> DataFrame:
    """A store after (content_hash, n) releases; content without references is deleted."""
    gone = released.groupBy("content_hash").agg(F.sum("n").alias("_n"))
    left = F.col("reference_count") - F.coalesce("_n", F.lit(0))
    return store.join(gone, "content_hash", "left").withColumn("reference_count", left).where("reference_count > 0").drop("_n")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, copies, first_id, last_id) of texts that several rows hold."""
    return docs.groupBy(fx.content_hash(text_col).alias("content_hash")).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where("copies > 1")


def upsert_last(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """MERGE of snapshots: for each key the row latest by order, all columns from that row."""
    rows = old.unionByName(new)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def upsert_sessions(old: DataFrame, new: DataFrame, key: str = "session_id", keep: tuple[str, ...] = ("system_prompt", "model_id"), always: tuple[str, ...] = ("agent", "updated_at")) -> DataFrame:
    """Sessions after an upsert: empty strings keep the old value, the always columns are overwritten."""
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(f"b.{key}", f"a.{key}").alias(key)]
    cols += [F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"a.{c}")).alias(c) for c in keep]
    cols += [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in always]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def merge_metadata(items: DataFrame, updates: DataFrame, key: str = "item_id", column: str = "metadata") -> DataFrame:
    """Items with the maps of updates laid over theirs; keys of the update win."""
    new = updates.select(key, F.col(column).alias("_new"))
    rows = items.join(new, key, "left")
    over = F.map_concat(F.map_filter(column, lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False))), F.coalesce("_new", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return rows.withColumn(column, over).drop("_new")


def positions(messages: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    return messages.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))


def swap_context(items: DataFrame, swaps: DataFrame) -> DataFrame:
    """Context items (session_id, item_type, item_id, position) after (session_id, item_id, summary_id) swaps: a summary stands at the least position of what it replaces."""
    hit = items.join(swaps, ["session_id", "item_id"])
    summary = hit.groupBy("session_id", "summary_id").agg(F.min("position").alias("position")).select("session_id", F.lit("summary").alias("item_type"), F.col("summary_id").alias("item_id"), "position")
    return items.join(swaps, ["session_id", "item_id"], "left_anti").unionByName(summary)


def mark_compacted(parts: DataFrame, ids: DataFrame, at, key: str = "part_id") -> DataFrame:
    """Parts with compacted_at set to at for the given ids where it was null."""
    flag = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return parts.join(flag, key, "left").withColumn("compacted_at", F.coalesce("compacted_at", F.when(F.col("_hit"), at))).drop("_hit")


def existing_buffers(new: DataFrame, buffers: DataFrame, keys: tuple[str, ...] = ("agent_id", "content_hash", "content_type", "strategy", "chunk_size", "overlap")) -> DataFrame:
    """New buffers with the id of the newest equal one, null where there is none."""
    last = buffers.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), "buffer_id"))).where("_n = 1").select(*keys, F.col("buffer_id").alias("existing_id"))
    return new.join(last, list(keys), "left")


def multi_get(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the ids in the order of the list; missing ids are left out."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    asked = spark.createDataFrame(list(enumerate(ids)), f"place long, {key} {kind}")
    return asked.join(rows, key).orderBy("place")


def latest_message(hits: DataFrame, messages: DataFrame, on: str = "content_hash", order: str = "created_at") -> DataFrame:
    """Each hit with the newest message of its content, nulls where there is none."""
    last = messages.groupBy(on).agg(F.max(F.struct(order, "message_id")).alias("_m")).select(on, F.col("_m.message_id").alias("message_id"), F.col(f"_m.{order}").alias(order))
    return hits.join(last, on, "left")


def cleanup(store: DataFrame, cutoff) -> DataFrame:
    """A store (with last_accessed) without content that nothing refers to and that was last read before the cutoff."""
    return store.where((F.col("reference_count") > 0) | (F.col("last_accessed") >= cutoff))


def expand_refs(texts: DataFrame, store: DataFrame, id_col: str = "id", text_col: str = "text", missing: str = "keep") -> DataFrame:
    """(id, expanded): texts with each ``[ref:key]`` replaced by the content of the key in a store (ref_id, content); unknown ones stay, or go with missing="empty"."""
    pieces = F.split(text_col, r"(?=\[ref:[^\]]+\])|(?<=\])")
    each = texts.select(id_col, F.posexplode(pieces).alias("_i", "_p")).withColumn("ref_id", F.nullif(F.regexp_extract("_p", r"^\[ref:([^\]]+)\]$", 1), F.lit("")))
    both = each.join(store.select("ref_id", "content"), "ref_id", "left")
    shown = F.coalesce("content", F.when(F.col("ref_id").isNotNull(), F.lit("") if missing == "empty" else F.col("_p")).otherwise(F.col("_p")))
    return both.select(id_col, F.struct("_i", shown.alias("t")).alias("_s")).groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["t"]), "").alias("expanded"))


def existing_items(items: DataFrame, new: DataFrame, config: tuple[str, ...] = ("agent_id", "chunk_size", "overlap")) -> DataFrame:
    """(new_id, item_id, chunk_index): stored items with the chunk configuration of a new document and its content or its path, in order of index; the two ways of being the same are two equi-joins."""
    n = new.select("new_id", *config, "raw_content_id", "source_path")
    found = [n.drop(other).join(items.select("item_id", "chunk_index", *config, key), [*config, key]).select("new_id", "item_id", "chunk_index") for key, other in (("raw_content_id", "source_path"), ("source_path", "raw_content_id"))]
    return found[0].unionByName(found[1]).distinct()
