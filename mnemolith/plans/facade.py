"""Registered queries of the facade: the supplied conversations and documents stored in a memory, and read from it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.memory import Memory
from mnemolith.sources import files
from mnemolith.sources import tables as src

from . import oracles as o
from . import registry as r
from .registry import ASKED, query


def memory(spark, d) -> Memory:
    """A memory that holds all conversations and all documents, written by the first query that asks for it."""

    def build(path: str) -> None:
        m = Memory(spark, path)
        m.store_session(r.convs(spark, d).select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text"), "talk", 100.0)
        m.load(r.docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content")), "docs", 200.0, 1000, 100)

    both = r.convs(spark, d).select("text").unionByName(r.docs(spark, d).select("text"))
    return Memory(spark, src.derived(spark, "memory", both, build))


TOLD = f"c0 AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'assistant' END AS role, text, CAST({o.TOKENS.format('text')} AS BIGINT) AS tokens FROM conversations)"
LTM = "it AS (SELECT 'ltm_' || substr(sha256('talk' || chr(31) || 'message' || chr(31) || session_id || ':' || turn), 1, 32) AS item_id, session_id, turn, text FROM c0 WHERE text <> '')"


@query(f"WITH {TOLD} SELECT session_id, turn, role, tokens, sha256(text) AS text FROM c0")
def memory_messages(spark, d):
    return memory(spark, d).messages().select("session_id", "turn", "role", "tokens", fx.content_hash("text").alias("text"))


@query(f"WITH {TOLD} SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM c0 GROUP BY 1")
def memory_sessions(spark, d):
    return memory(spark, d).sessions().select("session_id", "messages", "user_messages", "tokens")


@query(f"WITH {TOLD}, {LTM} SELECT item_id, session_id, 'message:' || session_id || ':' || turn AS raw_ref, sha256(text) AS text FROM it")
def memory_items(spark, d):
    items = memory(spark, d).table("items").where("source_type = 'message'")
    return items.select("item_id", "session_id", F.concat_ws(":", "source_type", "source_id").alias("raw_ref"), fx.content_hash("text").alias("text"))


@query(f"WITH {TOLD}, {o.bm25_ctes('c0', 'session_id, turn', ASKED)}, t AS ({o.top('scored', 'query_id', 'session_id, turn', 5)}) SELECT query_id, rank, session_id, turn, role, score FROM t JOIN c0 USING (session_id, turn)")
def memory_search(spark, d):
    return memory(spark, d).search(r.asked(spark), "talk", 5).select("query_id", "rank", "session_id", "turn", "role", "score")


@query(f"WITH {TOLD}, {LTM}, {o.bm25_ctes('it', 'item_id', ASKED)}, t AS ({o.top('scored', 'query_id', 'item_id', 6)}) SELECT query_id, rank, item_id AS id, round(1.0 / (60 + rank), 8) AS fused, CASE WHEN rank = 1 THEN 'bm25' END AS champion_of FROM t")
def memory_recall(spark, d):
    return memory(spark, d).recall(r.asked(spark), "talk", 6).drop("preview")


BUFFERS = f"{o.chunk_ctes(1000, 100, 'dd')}, n AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1)"
DISTINCT = "dd AS (SELECT 'buf_' || substr(sha256('docs' || chr(31) || sha256(coalesce(text, '')) || chr(31) || '1000' || chr(31) || '100'), 1, 32) AS doc_id, coalesce(text, '') AS text, min('d' || doc_id) AS name FROM documents GROUP BY ALL)"


@query(f"WITH RECURSIVE {DISTINCT}, {BUFFERS} SELECT dd.doc_id AS buffer_id, name, CAST(strlen(text) AS BIGINT) AS size, coalesce(chunks, 0) AS chunks FROM dd LEFT JOIN n USING (doc_id)".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def memory_buffers(spark, d):
    return memory(spark, d).table("buffers").select("buffer_id", "name", "size", "chunks")


@query(f"WITH RECURSIVE {DISTINCT}, {BUFFERS} SELECT doc_id || '_' || chunk_index AS chunk_id, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, sha256(substr(text, char_start + 1, char_end - char_start)) AS content FROM chunks".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def memory_chunks(spark, d):
    return memory(spark, d).table("chunks").select("chunk_id", "char_start", "char_end", fx.content_hash("content").alias("content"))


@query(f"WITH RECURSIVE {DISTINCT}, {BUFFERS} SELECT doc_id AS buffer_id, chunk_index // 3 AS batch_index, string_agg(chunk_index, ',' ORDER BY chunk_index) AS chunk_ids FROM chunks GROUP BY 1, 2".replace("GROUP BY ALL", "GROUP BY 1, 2"))
def memory_dispatch(spark, d):
    return memory(spark, d).dispatch(batch=3).withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@query(f"WITH {TOLD}, t AS (SELECT *, sum(tokens + 5) OVER (PARTITION BY session_id ORDER BY turn DESC) AS running FROM c0) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS position, CAST(turn AS VARCHAR) AS item_id, tokens FROM t WHERE running <= 5000")
def memory_context(spark, d):
    return memory(spark, d).context(5000).select("session_id", "position", "item_id", "tokens")


@query(f"WITH {TOLD} SELECT 'messages' AS \"table\", count(*) AS n FROM c0 UNION ALL SELECT 'parts', count(*) FROM c0 UNION ALL SELECT 'context', count(*) FROM c0 UNION ALL SELECT 'summaries', 0")
def memory_counts(spark, d):
    m = memory(spark, d)
    return files.table_counts({name: m.table(name) for name in ("messages", "parts", "context", "summaries")})
