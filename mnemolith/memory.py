"""The engine as one object over a folder of Parquet tables.

Tables are append-only logs: a write adds rows with the number of its batch, and a read takes the last row of each key.
So a repeated write changes nothing, readers never see half a batch of one table, and ``vacuum`` writes a log's present state as
its next generation. Batches are numbered by the clock, so writers need not know of each other; all other times are given by the caller; ids
are hashes of natural keys.
"""

from __future__ import annotations

import time
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.operators import bundle, chunking, content, fusion, lexical, lifecycle, mapreduce, parts, session, summary, vector
from mnemolith.sources.tables import cut, no_shuffle_files_left

#: Columns and key of each table.
TABLES = {
    "messages": ("session_id string, turn long, agent_id string, role string, text string, tokens long, is_summary boolean, created_at double", ["session_id", "turn"]),
    "parts": ("session_id string, turn long, part_index long, part_id string, part_type string, content string, tool_name string, tool_call_id string, tool_state string, compacted_at double", ["part_id"]),
    "items": (
        "item_id string, agent_id string, source_type string, source_id string, session_id string, text string, confidence string, controller_ignored boolean, merge_key string, "
        "superseded_by array<string>, supersedes array<string>, contradicts array<string>, contradicted_by array<string>, valid_to double, freshness double, indexed_at double, raw_refs array<string>",
        ["item_id"],
    ),
    "buffers": ("buffer_id string, agent_id string, name string, content_hash string, chunk_size long, overlap long, size long, chunks long, created_at double", ["buffer_id"]),
    "chunks": ("chunk_id string, buffer_id string, agent_id string, chunk_index long, char_start long, char_end long, byte_start long, byte_end long, start_line long, end_line long, has_overlap boolean, content string", ["chunk_id"]),
    "summaries": ("summary_id string, session_id string, level long, span_start long, span_end long, tokens long, content string, superseded boolean, children array<string>, file_ids array<string>, created_at double", ["summary_id"]),
    "context": ("session_id string, item_type string, item_id string, position long, gone boolean", ["session_id", "item_type", "item_id"]),
    "results": ("buffer_id string, batch_index long, chunk_ids array<long>, analysis string, tokens long, status string, error string, error_type string, transient boolean, retries long", ["buffer_id", "batch_index"]),
    "embeddings": ("model string, content_hash string, embedding array<float>", ["model", "content_hash"]),
    "postings": (lexical.SEGMENT + ", bucket int", ["bucket", "segment", "term"]),
}
#: Tables that are dealt to folders by columns, so that a read of some of them leaves the rest alone.
FOLDERS = {"postings": ["bucket"]}
#: Chunks are posted in so many rounds; the shuffle files of each, of postings, are gone before the next.
POST_ROUNDS = 3
#: Repeated keys of a log up to this number are broadcast to it.
FEW_KEYS = 100_000
NONE = "cast(null as {})"


class Memory:
    """encode: an optional embedder, from a list of texts to rows of ``dimensions`` numbers; without it recall is lexical."""

    def __init__(self, spark: SparkSession, root: str, encode=None, model: str = "none", dimensions: int = 0) -> None:
        self.spark, self.root, self.encode, self.model, self.dimensions = spark, root.rstrip("/"), encode, model, dimensions

    # --- tables

    def _generations(self, name: str) -> list[int]:
        """Numbers of the generations of a log that are there in whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("g"))

    def log(self, name: str) -> DataFrame:
        schema = TABLES[name][0] + ", batch long"
        found = self._generations(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/g{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """The present rows: the last of each key. Which keys repeat is looked up first, so that only their rows are sorted and others are read as they lie."""
        key, log = TABLES[name][1], self.log(name)
        last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("batch")))
        present = lambda rows: rows.withColumn("_n", last).where("_n = 1").drop("_n", "batch")
        if not self._generations(name):
            return log.drop("batch")
        again = log.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in key])
        with no_shuffle_files_left(self.spark):
            few = again.limit(FEW_KEYS + 1).count()
        if few > FEW_KEYS:
            return present(log)
        if not few:
            return log.drop("batch")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        return log.join(F.broadcast(again), same, "left_anti").drop("batch").unionByName(present(log.join(F.broadcast(again), same, "left_semi")))

    def write(self, name: str, rows: DataFrame) -> int:
        """Appends rows to a log and gives the number of their batch."""
        columns = [c.strip().rsplit(" ", 1) for c in TABLES[name][0].split(",")]
        at, batch = (self._generations(name) or [0])[-1], time.time_ns()
        with no_shuffle_files_left(self.spark):
            rows.select(*[F.col(c).cast(t).alias(c) for c, t in columns], F.lit(batch).alias("batch")).write.mode("append").option("compression", "zstd").partitionBy(*FOLDERS.get(name, [])).parquet(f"{self.root}/{name}/g{at}")
        return batch

    def vacuum(self, name: str) -> None:
        """Writes a log's present state as its next generation, for reads to come; reads that have begun go on in the one before, which stays until the next vacuum. No writer may run beside it."""
        if not (found := self._generations(name)):
            return
        now = self.table(name).withColumn("batch", F.lit(0).cast("long"))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        new, fs = path(f"{self.root}/{name}/g{found[-1] + 1}"), path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        now.write.mode("overwrite").option("compression", "zstd").partitionBy(*FOLDERS.get(name, [])).parquet(f"{self.root}/{name}/_new")
        fs.rename(path(f"{self.root}/{name}/_new"), new)
        for old in found[:-1]:
            fs.delete(path(f"{self.root}/{name}/g{old}"), True)

    def counts(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in TABLES}

    # --- the inverted index of messages, items and chunks

    def post(self, texts: DataFrame, rounds: int = 1) -> None:
        """Adds texts (text) to the index, in segments of their own. A text is known by its hash, whether it is that of a message, an item or a chunk; searches look at the texts that are present. rounds: parts of the texts, by their hashes, that are posted one after the other."""
        every = texts.select(fx.content_hash(F.coalesce("text", F.lit(""))).alias("version"), fx.terms("text").alias("terms"))
        for i in range(rounds):
            rows = every if rounds == 1 else every.where(F.pmod(F.xxhash64("version"), F.lit(rounds)) == i)
            self.write("postings", lexical.dealt(lexical.segments(rows)))

    def bm25(self, present: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of present documents (doc_id, text); only the postings of the queries' terms are read, and no text but for its hash."""
        now = present.select("doc_id", fx.content_hash(F.coalesce("text", F.lit(""))).alias("version"))
        asked = lexical.asked_terms(queries)
        words = asked.select("term").distinct().withColumn("bucket", lexical.folder())
        few = words.limit(lexical.BROADCAST_TERMS + 1).count() <= lexical.BROADCAST_TERMS
        folders = [r.bucket for r in words.select("bucket").distinct().collect()]
        log = self.log("postings")
        lists = log.where(F.col("bucket") == lexical.LISTS).select("segment", F.posexplode(F.arrays_zip("versions", "lens")).alias("place", "_d"))
        # a text that was posted again has its place in the first segment only
        own = lists.groupBy(F.col("_d.versions").alias("version")).agg(F.min(F.struct("segment", "place", F.col("_d.lens").cast("long").alias("doc_len"))).alias("_x"))
        here = now.join(own, "version").select("doc_id", "_x.*")
        held = log.where(F.col("bucket").isin(folders)).join(F.broadcast(words) if few else words, ["bucket", "term"]).dropDuplicates(["segment", "term"])
        held = held.select("segment", "term", F.explode(F.arrays_zip("places", "tfs")).alias("_p")).select("segment", "term", F.col("_p.places").alias("place"), F.col("_p.tfs").cast("long").alias("tf"))
        held = held.join(here, ["segment", "place"]).select("doc_id", "doc_len", "term", "tf")
        stats = here.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("l")).select(F.struct("n", "l")).scalar()
        return lexical.scored(held.withColumn("_s", stats), F.col("_s.n"), F.col("_s.l"), asked, ["doc_id"])

    # --- conversations

    def store_session(self, turns: DataFrame, agent: str, at: float) -> None:
        """turns: (session_id, turn, role, text, optional parts). Texts are items of long-term memory as well, and every turn has its parts; turns that are there stay."""
        names = ["session_id", "turn"]
        rows = turns.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), fx.role_of_message("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), *[c for c in turns.columns if c == "parts"])
        rows = rows.join(self.table("messages").select(*names), names, "left_anti").cache()
        try:
            own = parts.parts_of(rows, names)
            said = parts.message_texts(own, names)
            whole = rows.drop("text", "parts").join(said, names).withColumn("agent_id", F.lit(agent)).withColumn("tokens", fx.tokens("text")).withColumn("is_summary", F.lit(False)).withColumn("created_at", F.lit(float(at)))
            self.post(whole.select(F.explode(F.array_distinct(F.array("text", "searchable"))).alias("text")))
            self.index(whole.where("searchable != ''").select("agent_id", F.lit("message").alias("source_type"), F.concat_ws(":", "session_id", F.col("turn").cast("string")).alias("source_id"), "session_id", F.col("searchable").alias("text")), at, posted=True)
            self.write("parts", own)
            self.write("context", whole.select("session_id", F.lit("message").alias("item_type"), F.col("turn").cast("string").alias("item_id"), (F.col("turn") + 1).alias("position"), F.lit(False).alias("gone")))
            self.write("messages", whole)
        finally:
            rows.unpersist()

    def messages(self) -> DataFrame:
        return self.table("messages").withColumn("position", F.col("turn") + 1)

    def search(self, queries: DataFrame, agent: str | None = None, k: int = 10) -> DataFrame:
        """(query_id, rank, session_id, turn, role, score, preview) of stored messages."""
        m = self.table("messages")
        m = m.where(F.col("agent_id") == agent) if agent else m
        m = m.withColumn("doc_id", F.concat_ws(":", "session_id", F.col("turn").cast("string")))
        found = self.bm25(m, queries).join(m.select("doc_id", "session_id", "turn", "role", fx.preview("text").alias("preview")), "doc_id").drop("doc_id")
        return lexical.ranked(found, ["query_id"], ["session_id", "turn"], k)

    def sessions(self) -> DataFrame:
        return session.session_stats(self.messages())

    # --- long-term items

    def index(self, items: DataFrame, at: float, posted: bool = False) -> None:
        """Adds items (agent_id, source_type, source_id, session_id, text and optional columns); an item of a known key replaces it, one with the merge key of others supersedes them. posted: their texts are in the index of texts."""
        have = set(items.columns)
        kinds = dict(c.strip().rsplit(" ", 1) for c in TABLES["items"][0].split(","))
        rows = items.withColumns({c: F.expr(NONE.format(t)) for c, t in kinds.items() if c not in have})
        rows = rows.withColumns({
            "item_id": F.coalesce("item_id", fx.stable_id("ltm_", "agent_id", "source_type", "source_id")), "confidence": F.coalesce("confidence", F.lit("medium")), "controller_ignored": F.coalesce("controller_ignored", F.lit(False)),
            "indexed_at": F.lit(float(at)), "freshness": F.coalesce("freshness", F.lit(float(at))), "raw_refs": F.array_union(F.coalesce("raw_refs", F.array().cast("array<string>")), F.array(F.concat_ws(":", "source_type", "source_id"))),
        })
        names = list(kinds)
        if "merge_key" in have:
            keyed = rows.where("merge_key is not null").select(F.col("item_id").alias("new_id"), "agent_id", "merge_key")
            old = self.table("items").where("valid_to is null and merge_key is not null").join(keyed, ["agent_id", "merge_key"]).where("item_id != new_id")
            touched = old.groupBy("item_id").agg(F.array_sort(F.collect_set("new_id")).alias("_by"))
            back = old.groupBy(F.col("new_id").alias("item_id")).agg(F.array_sort(F.collect_set("item_id")).alias("_of"))
            none = F.array().cast("array<string>")
            stale = self.table("items").join(touched, "item_id").withColumn("superseded_by", F.array_union(F.coalesce("superseded_by", none), "_by")).withColumn("valid_to", F.lit(float(at))).withColumn("freshness", F.lit(float(at)))
            rows = rows.join(back, "item_id", "left").withColumn("supersedes", F.when(F.col("_of").isNotNull(), F.array_union(F.coalesce("supersedes", none), "_of")).otherwise(F.col("supersedes")))
        if not posted:
            self.post(rows.select("text"))
        self.write("items", rows.select(*names).unionByName(stale.select(*names)) if "merge_key" in have else rows.select(*names))
        if self.encode:
            new, _ = vector.encode_missing(rows.select(F.col("text").alias("content")), self.table("embeddings"), self.encode, self.model, self.dimensions)
            self.write("embeddings", new)

    def recall(self, queries: DataFrame, agent: str | None = None, k: int = 10) -> DataFrame:
        """Hybrid recall (query_id, rank, id, fused, champion_of, preview) over items, filtered by agent before ranking."""
        items = self.table("items")
        items = items.where(F.col("agent_id") == agent) if agent else items
        lex = self.bm25(items.withColumnRenamed("item_id", "doc_id"), queries).withColumnRenamed("doc_id", "id")
        lex = lexical.ranked(lex, ["query_id"], ["id"], 4 * k).select("query_id", "id", "rank", "score")
        ranks = self.near(queries, items.select(F.col("item_id").alias("id"), "text"), 4 * k)
        return fusion.recall(lex, ranks, items.select(F.col("item_id").alias("id"), "text"), k)

    def active_recall(self, limit: int = 8, session_id: str | None = None) -> DataFrame:
        items = self.table("items")
        some = lambda c: F.when(F.size(c) > 0, F.element_at(c, 1))
        rows = items.withColumn("superseded_by", F.coalesce(some("superseded_by"), F.col("valid_to").cast("string"))).withColumn("supersedes", F.coalesce(some("supersedes"), some("contradicts")))
        return lifecycle.active_recall(rows, limit, session=session_id).select("agent_id", "rank", "item_id", "source_type", "score", "reasons", fx.preview("text").alias("preview"))

    def correct(self, agent: str, statement: str, wrong_id: str | None, at: float) -> str:
        """Records a correction; the wrong item, if given, becomes low in confidence and out of date. Gives the new item's id."""
        item = self.spark.createDataFrame([(agent, "correction", statement, statement, "high")], "agent_id string, source_type string, source_id string, text string, confidence string")
        item = item.withColumn("item_id", fx.stable_id("corr_", "agent_id", F.lit(wrong_id or ""), "text")).withColumn("session_id", F.lit(None).cast("string"))
        new_id = item.first().item_id
        if wrong_id:
            none = F.array().cast("array<string>")
            old = self.table("items").where((F.col("item_id") == wrong_id) & (F.col("agent_id") == agent))
            if not old.count():
                raise KeyError(wrong_id)
            item = item.withColumn("supersedes", F.array(F.lit(wrong_id)))
            self.write("items", old.withColumn("confidence", F.lit("low")).withColumn("valid_to", F.lit(float(at))).withColumn("superseded_by", F.array_union(F.coalesce("superseded_by", none), F.array(F.lit(new_id)))))
        self.index(item, at)
        return new_id

    def contradict(self, agent: str, statement: str, item_ids: list[str], at: float) -> str:
        """Records a statement that conflicts with items; links both ways, refused without a known item."""
        asked = self.spark.createDataFrame([(i,) for i in item_ids], "item_id string")
        old = self.table("items").where(F.col("agent_id") == agent).join(asked, "item_id", "left_semi")
        known = [r.item_id for r in old.select("item_id").collect()]
        if set(item_ids) - set(known) or not known:
            raise KeyError(f"unknown items: {sorted(set(item_ids) - set(known))}")
        item = self.spark.createDataFrame([(agent, "contradiction", statement, statement, sorted(known))], "agent_id string, source_type string, source_id string, text string, contradicts array<string>")
        item = item.withColumn("item_id", fx.stable_id("contra_", "agent_id", F.array_join("contradicts", "\n"), "text")).withColumn("session_id", F.lit(None).cast("string"))
        new_id = item.first().item_id
        none = F.array().cast("array<string>")
        self.write("items", old.withColumn("contradicted_by", F.array_union(F.coalesce("contradicted_by", none), F.array(F.lit(new_id)))))
        self.index(item, at)
        return new_id

    def find_contradictions(self, query: str | None = None, k: int = 10) -> DataFrame:
        items = self.table("items")
        return lifecycle.find_contradictions(items.select("item_id", "contradicts", "contradicted_by"), items, query, k)

    # --- documents

    def load(self, docs: DataFrame, agent: str, at: float, size: int = 4000, overlap: int = 200) -> DataFrame:
        """Loads documents (name, content): buffers, chunks and items of what is not there with this configuration. Gives (buffer_id, name, deduped)."""
        rows = docs.select(F.lit(agent).alias("agent_id"), "name", F.coalesce("content", F.lit("")).alias("content")).withColumn("content_hash", fx.content_hash("content"))
        rows = rows.withColumn("buffer_id", fx.stable_id("buf_", "agent_id", "content_hash", F.lit(str(size)), F.lit(str(overlap))))
        known = self.table("buffers").select("buffer_id", F.lit(True).alias("deduped"))
        found = rows.groupBy("buffer_id", "agent_id", "content_hash").agg(F.min("name").alias("name"), F.min(F.octet_length("content")).alias("size"))
        found = cut(found.join(known, "buffer_id", "left").withColumn("deduped", F.coalesce("deduped", F.lit(False))))
        done, new = found.select("buffer_id", "name", "deduped"), found.where("not deduped")
        if not new.limit(1).count():
            return done
        # the one shuffle of whole texts, gone when their chunks are written
        texts = rows.groupBy("buffer_id").agg(F.first("content").alias("content")).join(new.select("buffer_id"), "buffer_id", "left_semi")
        made = chunking.chunk_documents(texts, "buffer_id", "content", size, overlap).withColumns({"agent_id": F.lit(agent), "chunk_id": F.concat_ws("_", "buffer_id", F.col("chunk_index").cast("string"))})
        batch = self.write("chunks", made)
        own = self.log("chunks").where(F.col("batch") == batch)
        self.post(own.select(F.col("content").alias("text")), POST_ROUNDS)
        self.index(own.select("agent_id", F.lit("rlm_chunk").alias("source_type"), F.col("chunk_id").alias("source_id"), F.lit(None).cast("string").alias("session_id"), F.col("content").alias("text")), at, posted=True)
        n = own.groupBy("buffer_id").agg(F.count("*").alias("chunks"))
        self.write("buffers", new.join(n, "buffer_id", "left").withColumns({"chunk_size": F.lit(size), "overlap": F.lit(overlap), "chunks": F.coalesce("chunks", F.lit(0)), "created_at": F.lit(float(at))}))
        return done

    def near(self, queries: DataFrame, contents: DataFrame, k: int) -> DataFrame:
        """(query_id, id, rank, score): the k nearest of contents (id, text) by the vectors of their texts; none without an embedder."""
        empty = self.spark.createDataFrame([], "query_id long, id string, rank long, score double")
        if not self.encode:
            return empty
        asked = queries.select("query_id", F.col("query").alias("content"))
        now, _ = vector.encode_missing(asked, self.table("embeddings").limit(0), self.encode, self.model, self.dimensions)
        asked = asked.withColumn("content_hash", fx.content_hash("content")).join(now, "content_hash").select("query_id", "embedding")
        own = contents.select("id", fx.content_hash("text").alias("content_hash"))
        held = self.table("embeddings").where(F.col("model") == self.model).join(own.select("content_hash").distinct(), "content_hash", "left_semi").withColumn("n", F.xxhash64("content_hash"))
        best = vector.cosine_topk(held, asked, k, id_col="n").join(held.select("n", "content_hash"), "n").join(own, "content_hash").select("query_id", "id", "score")
        return lexical.ranked(best, ["query_id"], ["id"], k).select("query_id", "id", "rank", "score")

    def search_chunks(self, queries: DataFrame, buffer_id: str | None = None, k: int = 10, mode: str = "bm25") -> DataFrame:
        """(query_id, rank, chunk_id, score, preview) by mode: bm25, semantic or hybrid."""
        c = self.table("chunks")
        c = c.where(F.col("buffer_id") == buffer_id) if buffer_id else c
        lex = self.bm25(c.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), queries).withColumnRenamed("doc_id", "id")
        lex = lexical.ranked(lex, ["query_id"], ["id"], 3 * k).select("query_id", "id", "rank", "score")
        near = self.near(queries, c.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), 3 * k) if mode != "bm25" else lex.limit(0)
        best = fusion.by_mode(lex, near, mode, k).withColumnRenamed("id", "chunk_id")
        return best.join(c.select("chunk_id", fx.preview("content", 240).alias("preview")), "chunk_id")

    def chunks(self, buffer_id: str | None = None, limit: int = 100) -> DataFrame:
        """The first chunks in order of buffer and index."""
        return chunking.list_chunks(self.table("chunks"), "buffer_id", limit, buffer_id)

    def chunk(self, ids: list[str]) -> DataFrame:
        return content.multi_get(self.table("chunks"), ids, "chunk_id")

    def source(self, item_ids: list[str]) -> DataFrame:
        """(item_id, raw_ref, agent_id, text) of items, in the order asked for: what a recalled ref points to."""
        rows = self.table("items").withColumn("raw_ref", F.concat_ws(":", "source_type", "source_id"))
        return content.multi_get(rows, item_ids, "item_id").select("item_id", "raw_ref", "agent_id", "text")

    def record(self, buffer_id: str, batch_index: int, analysis: str, batch: int = 4) -> DataFrame:
        """Records an analysis that was made elsewhere, for a batch that has none; gives the result that stands."""
        plan = self.dispatch(buffer_id, batch).where(F.col("batch_index") == batch_index)
        kinds = dict(c.strip().rsplit(" ", 1) for c in TABLES["results"][0].split(","))
        said = {"analysis": F.lit(analysis), "tokens": fx.tokens(F.lit(analysis)), "status": F.lit("ok"), "retries": F.lit(0)}
        new = plan.withColumns({c: F.expr(NONE.format(t)) for c, t in kinds.items() if c not in plan.columns and c not in said} | said)
        self.write("results", new.join(self.table("results").where("status = 'ok'").select("buffer_id", "batch_index"), ["buffer_id", "batch_index"], "left_anti"))
        return self.table("results").where((F.col("buffer_id") == buffer_id) & (F.col("batch_index") == batch_index))

    def dispatch(self, buffer_id: str | None = None, batch: int | None = None) -> DataFrame:
        """(buffer_id, batch_index, chunk_ids): the plan of an analysis."""
        c = self.table("chunks")
        c = c.where(F.col("buffer_id") == buffer_id) if buffer_id else c
        return chunking.batches(c, ["buffer_id"], ["chunk_index"], batch).groupBy("buffer_id", "batch_index").agg(F.array_sort(F.collect_list("chunk_index")).alias("chunk_ids"))

    def analyse(self, analyser=mapreduce.first_words, buffer_id: str | None = None, batch: int | None = 4, limit: int = mapreduce.LIMIT_TOKENS, rounds: int = 3, at: float = 0.0) -> DataFrame:
        """Map, reduce and recurse over a buffer's chunks; batches that are recorded are not analysed again. Analyses and aggregates become items."""
        c = self.table("chunks")
        c = c.where(F.col("buffer_id") == buffer_id) if buffer_id else c
        plan = chunking.batches(c, ["buffer_id"], ["chunk_index"], batch)
        todo = plan.join(self.table("results").where("status = 'ok'").select("buffer_id", "batch_index"), ["buffer_id", "batch_index"], "left_anti")
        self.write("results", mapreduce.run_batches(todo, analyser, "buffer_id"))
        want = plan.groupBy("buffer_id").agg((F.max("batch_index") + 1).alias("batches"))
        results = self.table("results").join(want.select("buffer_id"), "buffer_id", "left_semi")
        lacking = mapreduce.completeness(results.where("status = 'ok'"), want, "buffer_id").where("size(missing) > 0")
        if bad := lacking.select("buffer_id", "missing").first():
            raise RuntimeError(f"batches {bad.missing} of {bad.buffer_id} are missing")
        whole = cut(mapreduce.recurse(mapreduce.aggregate(results, "buffer_id"), analyser, limit, rounds, "buffer_id"))
        if big := mapreduce.refused(whole, limit).select("buffer_id", "tokens").first():
            raise RuntimeError(f"the result of {big.buffer_id} has {big.tokens} tokens after {rounds} rounds, {limit} are allowed")
        owner = self.table("buffers").select("buffer_id", "agent_id")
        ref = lambda i: F.concat(F.lit("rlm_chunk:"), F.col("buffer_id"), F.lit("_"), i.cast("string"))
        parts = results.select("buffer_id", F.lit("rlm_analysis").alias("source_type"), F.concat_ws(":", "buffer_id", F.col("batch_index").cast("string")).alias("source_id"), F.col("analysis").alias("text"), F.transform("chunk_ids", ref).alias("raw_refs"))
        sums = whole.select("buffer_id", F.lit("rlm_summary").alias("source_type"), F.col("buffer_id").alias("source_id"), "text", F.transform("chunk_ids", ref).alias("raw_refs"))
        self.index(parts.unionByName(sums).join(owner, "buffer_id").withColumn("session_id", F.lit(None).cast("string")).drop("buffer_id"), at)
        return whole

    # --- context

    def compact(self, budget: session.Budget = session.Budget(), keep: int = 2, at: float = 0.0, hard_only: bool = False, force: bool = False, rounds: int = 3, protect_tokens: int = 40_000, least: int = 20_000) -> DataFrame:
        """Compacts the sessions over their budget, all at once: (session_id, triggered, deferred, rounds, before, after, effective, summaries) of those due.

        Old tool outputs are pruned first; then rounds of summaries, and summaries of summaries, until a session is below its soft limit or nothing shrinks it.
        """
        view = self._items()
        cost = view.groupBy("session_id").agg(F.sum(F.col("tokens") + session.OVERHEAD).alias("context_tokens"))
        due = cost if force else session.compaction_due(cost, budget, hard_only=hard_only)
        due = cut(due.select("session_id"))
        seen = self.table("parts").join(due, "session_id", "left_semi").join(self.messages().select("session_id", "turn", "position", "role", "is_summary"), ["session_id", "turn"])
        tool = seen.withColumns({"is_protected": F.lit(False), "compacted": F.col("compacted_at").isNotNull(), "tokens": fx.tokens("content")})
        old = session.prune_tools(tool, protect_tokens, least).select("part_id")
        self.write("parts", cut(content.mark_compacted(self.table("parts").join(old, "part_id", "left_semi"), old, F.lit(float(at)))))
        after, made, report = summary.compact_context(cut(self._items()), budget, keep, rounds, force, defer_soft=hard_only)
        report = cut(report)
        if made is not None:
            made = cut(made)
            self.write("summaries", made.withColumns({"superseded": F.lit(False), "created_at": F.lit(float(at))}))
            taken = made.where("condensed").select(F.explode("children").alias("summary_id"))
            self.write("summaries", cut(self.table("summaries").join(taken, "summary_id", "left_semi").withColumn("superseded", F.lit(True))))
            gone = made.select("session_id", F.when(F.col("condensed"), "summary").otherwise("message").alias("item_type"), F.explode("replaced").alias("item_id"))
            stands = made.select("session_id", F.lit("summary").alias("item_type"), F.col("summary_id").alias("item_id"), "position", F.lit(False).alias("gone"))
            items = stands.unionByName(self.table("context").drop("gone").unionByName(stands.drop("gone")).join(gone, ["session_id", "item_type", "item_id"], "left_semi").withColumn("gone", F.lit(True)))
            last = items.groupBy("session_id", "item_type", "item_id").agg(F.min("position").alias("position"), F.max("gone").alias("gone"))
            self.write("context", cut(last))
        return report.where("triggered or deferred")

    def _items(self) -> DataFrame:
        """What each session's context holds now, summaries without their heads: the view that compaction works on."""
        items = self.table("context").where("not gone").drop("gone")
        m = self.messages().select("session_id", F.col("turn").cast("string").alias("item_id"), F.lit("message").alias("item_type"), "role", "turn", F.col("text").alias("_t"), F.col("tokens").alias("_n"))
        said = parts.message_texts(self.table("parts"), ["session_id", "turn"]).select("session_id", "turn", F.col("text").alias("_p"))
        m = m.join(said, ["session_id", "turn"], "left").select("session_id", "item_id", "item_type", "role", F.coalesce("_p", "_t").alias("text")).withColumn("tokens", fx.tokens("text"))
        m = m.withColumns({"level": F.lit(-1).cast("long"), "span_start": F.col("item_id"), "span_end": F.col("item_id")})
        s = self.table("summaries").where("not superseded").select("session_id", F.col("summary_id").alias("item_id"), F.lit("summary").alias("item_type"), F.lit("assistant").alias("role"), F.col("content").alias("text"), fx.tokens(summary.node_text(F.col("summary_id"), F.col("content"))).alias("tokens"), "level", F.col("span_start").cast("string").alias("span_start"), F.col("span_end").cast("string").alias("span_end"))
        return items.join(m.unionByName(s), ["session_id", "item_type", "item_id"]).select("session_id", "position", "item_type", "item_id", "role", "text", "tokens", "level", "span_start", "span_end")

    def view(self) -> DataFrame:
        """(session_id, position, item_type, item_id, role, text, tokens) of what each session's context holds now, summaries with their heads."""
        text = F.when(F.col("item_type") == "summary", summary.node_text(F.col("item_id"), F.col("text"))).otherwise(F.col("text"))
        return self._items().withColumn("text", text).drop("level", "span_start", "span_end")

    def context(self, budget: int, system_prompt: str = "") -> DataFrame:
        """For all sessions: the system prompt, summaries from the oldest on, then the newest messages that fit what they leave; what is too long for what is left is cut."""
        return session.build_context(self.view(), budget, system_prompt).withColumnsRenamed({"place": "position", "source": "item_type", "source_id": "item_id"})

    def bundle(self, session_id: str, queries: DataFrame, agent: str | None = None, budget: int = 4000, recall_budget: int = 2000, k: int = 10) -> dict[str, DataFrame]:
        """What one answer needs: messages of the session, recalled and active items, the injection policy that fits, and where all of it comes from."""
        kept = self.context(budget).where(F.col("session_id") == session_id)
        found = self.recall(queries, agent, k)
        texts = self.table("items").select(F.col("item_id").alias("id"), F.col("text").alias("full"))
        hits = found.join(texts, "id").withColumn("snippet", F.substring("full", 1, 720)).withColumn("champion", F.when(F.col("champion_of").isNotNull(), F.col("full")).otherwise(F.col("preview")))
        active = self.active_recall(session_id=session_id)
        refs = kept.withColumn("ref", F.concat_ws(":", "item_type", "session_id", "item_id"))
        return {"messages": kept, "recall": found, "active": active, "policy": bundle.choose_policy(hits, recall_budget), "provenance": bundle.provenance(refs, found, active)}
