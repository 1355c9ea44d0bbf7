"""The registered queries of the engine over the supplied tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.operators import bundle, chunking, content, evaluate, fusion, lexical, lifecycle, mapreduce, session, summary, vector
from mnemolith.sources import files
from mnemolith.sources import tables as src
from mnemolith.streaming import sessions

from . import oracles as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ASKED = [(1, "anea the thhaha"), (2, "des les eauier"), (3, "und der keit"), (4, "los que arco"), (5, "of and with from ertion"), (6, "nothing_matches zzz")]
BUDGET = 400
USERS = "role = 'user'"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id long, query string")


def docs(spark, d):
    return src.table(spark, d, "documents")


def convs(spark, d):
    return src.table(spark, d, "conversations")


def msgs(spark, d):
    return src.messages(convs(spark, d))


def index(spark, d, name, keys, text="text", rows=None):
    """The stored inverted index of a table, or of rows derived from it, written by the first query that asks for it."""
    table = src.table(spark, d, name if rows is None else "documents")
    return lexical.Index(spark, src.derived(spark, f"{name}-index", table, lambda path: lexical.Index.build(table if rows is None else rows(), keys, path, text)))


def chunks(spark, d):
    """The stored chunks of all documents in the default size."""
    rows = docs(spark, d)
    return spark.read.parquet(src.derived(spark, "chunks", rows, lambda path: chunking.chunk_documents(rows).write.parquet(path)))


# --- terms and lexical search


@query(f"SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_words, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, array_to_string(list_sort(list_distinct(t)), ' ') AS words FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM conversations)".replace("{{", "{").replace("}}", "}"))
def tokenize_terms(spark, d):
    t = fx.query_words("text", distinct=False)
    return convs(spark, d).select("conv_id", "turn", F.size(t).cast("long").alias("n_words"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct(t)), " ").alias("words"))


@query(f"WITH e AS (SELECT conv_id, turn, unnest({o.TERMS.format('text')}) AS term FROM conversations), p AS (SELECT conv_id, turn, term, count(*) AS tf FROM e GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term")
def term_stats(spark, d):
    return lexical.term_stats(convs(spark, d), ["conv_id", "turn"])


@query(f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms, round(avg(n), 6) AS avgdl FROM (SELECT len({o.TERMS.format('text')}) AS n FROM documents)")
def corpus_stats(spark, d):
    return lexical.corpus_stats(docs(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {o.bm25_ctes('conversations', 'conv_id, turn', ASKED)} {o.top('scored', 'query_id', 'conv_id, turn', 10)}")
def bm25_search(spark, d):
    return index(spark, d, "conversations", ["conv_id", "turn"]).search(asked(spark), ["conv_id", "turn"], 10)


@query(f"WITH {o.bm25_ctes('documents', 'doc_id', ASKED)} {o.top('scored', 'query_id', 'doc_id', 10)}")
def bm25_topk_multi(spark, d):
    return index(spark, d, "documents", ["doc_id"]).search(asked(spark), ["doc_id"], 10)


@query(f"WITH {o.bm25_ctes('documents', 'doc_id', ASKED)} {o.top('scored', 'query_id', 'doc_id', 10)}")
def bm25_unindexed(spark, d):
    return lexical.bm25(docs(spark, d), asked(spark), ["doc_id"], 10)


@query(f"WITH {o.bm25_ctes('conversations', 'conv_id, turn', ASKED, where=USERS)} {o.top('scored', 'query_id', 'conv_id, turn', 5)}")
def bm25_role_filtered(spark, d):
    return lexical.bm25(convs(spark, d).where("role = 'user'"), asked(spark), ["conv_id", "turn"], 5)


@query(f"""WITH q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM {o.values(ASKED)} t(query_id, query)),
s AS (SELECT query_id, doc_id, CAST(sum((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)) AS BIGINT) AS score FROM documents, q GROUP BY ALL HAVING score > 0) {o.top('s', 'query_id', 'doc_id', 10)}""")
def term_count_fallback(spark, d):
    return lexical.term_counts(docs(spark, d), asked(spark), ["doc_id"], 10)


# --- vectors and fusion


def vectors(spark, d):
    return src.table(spark, d, "embeddings")


def asked_vectors(spark, d):
    """The stated query set: every vector whose id is divisible by 100, against all."""
    return vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


COSINE = "SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"


@query(f"WITH s AS ({COSINE}), p AS (SELECT query_id, vec_id, score FROM s WHERE score > 0) {o.top('p', 'query_id', 'vec_id', 10)}")
def vector_topk(spark, d):
    return vector.cosine_topk(vectors(spark, d), asked_vectors(spark, d), 10)


@query(f"WITH s AS ({COSINE}), p AS (SELECT query_id, vec_id, score FROM s WHERE score > 0 AND label = 3) {o.top('p', 'query_id', 'vec_id', 10)}")
def vector_topk_labelled(spark, d):
    return vector.cosine_topk(vectors(spark, d).where("label = 3"), asked_vectors(spark, d), 10)


@query(f"WITH s AS ({COSINE}) SELECT query_id, count(*) AS hits, round(min(score), 6) AS least FROM s WHERE score > 0 GROUP BY query_id")
def vector_positive_only(spark, d):
    return vector.cosine_hits(vectors(spark, d), asked_vectors(spark, d)).select("query_id", "hits", F.round("least", 6).alias("least"))


def two_streams(spark, d, k=20):
    """Lexical hits of documents and vector hits, an embedding standing for the document of its number."""
    lex = index(spark, d, "documents", ["doc_id"]).search(asked(spark), ["doc_id"], k).select("query_id", F.col("doc_id").alias("id"), "rank", "score")
    vec = vector.cosine_topk(vectors(spark, d), asked_vectors(spark, d), k).select("query_id", F.col("vec_id").alias("id"), "rank", "score")
    return lex, vec


STREAMS = f"""{o.bm25_ctes('documents', 'doc_id', ASKED)}, lex AS ({o.top('scored', 'query_id', 'doc_id', 20)}),
cs AS ({COSINE}), cp AS (SELECT query_id, vec_id, score FROM cs WHERE score > 0), vec AS ({o.top('cp', 'query_id', 'vec_id', 20)}),
r AS (SELECT 'bm25' AS stream, query_id, doc_id AS id, rank, score FROM lex UNION ALL SELECT 'vector', query_id, vec_id, rank, score FROM vec)"""
ACTIVE = "w AS (SELECT query_id, sum(0.5) AS all_w FROM (SELECT DISTINCT query_id, stream FROM r) GROUP BY query_id), f AS (SELECT query_id, id, round(sum(0.5 / all_w / (60 + rank)), 8) AS fused FROM r JOIN w USING (query_id) GROUP BY ALL)"
ENSEMBLE = "ch AS (SELECT query_id, id, min(stream) AS champion_of FROM r WHERE rank = 1 GROUP BY ALL), en AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY champion_of IS NULL, champion_of, fused DESC, id) AS rank FROM f LEFT JOIN ch USING (query_id, id))"


@query(f"WITH {STREAMS} SELECT query_id, id, round(sum(CASE stream WHEN 'bm25' THEN 0.6 ELSE 0.4 END / (60 + rank)), 8) AS fused FROM r GROUP BY ALL")
def rrf_hybrid(spark, d):
    lex, vec = two_streams(spark, d)
    return fusion.rrf(fusion.streams(bm25=lex, vector=vec), {"bm25": 0.6, "vector": 0.4}).drop("contributions")


@query(f"WITH {STREAMS}, {ACTIVE} SELECT query_id, id, fused FROM f")
def rrf_active_streams(spark, d):
    lex, vec = two_streams(spark, d)
    return fusion.rrf(fusion.streams(bm25=lex, vector=vec), {"bm25": 0.5, "vector": 0.5}, active_only=True).drop("contributions")


@query(f"WITH {STREAMS} SELECT query_id, id, stream, rank, score, round(0.5 / (60 + rank), 8) AS contribution FROM r")
def rrf_contributions(spark, d):
    lex, vec = two_streams(spark, d)
    rows = fusion.rrf(fusion.streams(bm25=lex, vector=vec), {"bm25": 0.5, "vector": 0.5}).select("query_id", "id", F.explode("contributions").alias("stream", "c"))
    return rows.select("query_id", "id", "stream", "c.rank", "c.score", "c.contribution")


@query(f"WITH {STREAMS}, {ACTIVE}, {ENSEMBLE} SELECT query_id, id, fused, champion_of, rank FROM en WHERE rank <= 8")
def ensemble_selection(spark, d):
    ranks = fusion.streams(**dict(zip(("bm25", "vector"), two_streams(spark, d))))
    return fusion.ensemble(fusion.rrf(ranks, {"bm25": 0.5, "vector": 0.5}, active_only=True), ranks, 8).drop("contributions")


@query(f"WITH {o.bm25_ctes('documents', 'doc_id', ASKED)}, t AS ({o.top('scored', 'query_id', 'doc_id', 20)}), x AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM t WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS normalised FROM x")
def minmax_normalise(spark, d):
    best = index(spark, d, "documents", ["doc_id"]).search(asked(spark), ["doc_id"], 20)
    return fusion.minmax(best, ["query_id"]).select("query_id", "doc_id", F.round("normalised", 6).alias("normalised"))


PREVIEW = "CASE WHEN length({s}) > 420 THEN rtrim(substr({s}, 1, 419)) || '…' ELSE {s} END".replace("{s}", "trim(regexp_replace({0}, '\\s+', ' ', 'g'))")


@query(f"WITH {STREAMS}, {ACTIVE}, {ENSEMBLE} SELECT query_id, en.rank, id, fused, champion_of, {PREVIEW.format('text')} AS preview FROM en JOIN documents ON doc_id = id WHERE rank <= 10")
def recall_with_content(spark, d):
    lex, vec = two_streams(spark, d)
    return fusion.recall(lex, vec, docs(spark, d).select(F.col("doc_id").alias("id"), "text"), 10)


@query(f"WITH {STREAMS} SELECT query_id, stream, count(*) AS hits, min_by(id, rank) AS champion FROM r GROUP BY ALL")
def stream_champions(spark, d):
    lex, vec = two_streams(spark, d)
    return evaluate.stream_counts(fusion.streams(bm25=lex, vector=vec))


@query("WITH h AS (SELECT DISTINCT sha256(text) AS content_hash FROM conversations), l AS (SELECT sha256(text) AS content_hash, max(conv_id * 1000 + turn) AS message_id FROM conversations WHERE role <> 'system' GROUP BY ALL) SELECT content_hash, message_id FROM h LEFT JOIN l USING (content_hash)")
def hit_latest_message(spark, d):
    rows = convs(spark, d).select(fx.content_hash("text").alias("content_hash"), "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"))
    return content.latest_message(rows.select("content_hash").distinct(), rows.where("role != 'system'").withColumn("created_at", F.col("message_id"))).select("content_hash", "message_id")


@query(f"WITH {STREAMS}, {ACTIVE}, {ENSEMBLE}, p AS (SELECT query_id, en.rank, champion_of, '[' || en.rank || '] item:' || id || chr(10) || {PREVIEW.format('text')} AS t FROM en JOIN documents ON doc_id = id WHERE rank <= 10), b AS (SELECT query_id, count(*) AS hits, count(champion_of) AS champions, string_agg(t, chr(10) ORDER BY rank) AS block FROM p GROUP BY query_id) SELECT *, length(block) AS chars FROM b")
def recall_block(spark, d):
    return fusion.recall_block(recall_with_content(spark, d))


# --- content store and manifests


@query("SELECT sha256(text) AS content_hash, CAST(count(*) - 1 AS BIGINT) AS reference_count FROM documents GROUP BY 1 HAVING count(*) > 1 OR max(doc_id) >= 100")
def content_cleanup(spark, d):
    rows = docs(spark, d).groupBy(fx.content_hash("text").alias("content_hash")).agg((F.count("*") - 1).alias("reference_count"), F.max("doc_id").alias("last_accessed"))
    return content.cleanup(rows, 100).select("content_hash", "reference_count")


@query("SELECT doc_id, 'see ' || sha256(text) || ' and [ref:zz]!' AS expanded FROM documents")
def ref_expand(spark, d):
    texts = docs(spark, d).select("doc_id", F.concat(F.lit("see [ref:d"), F.col("doc_id").cast("string"), F.lit("] and [ref:zz]!")).alias("text"))
    store = docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("ref_id"), fx.content_hash("text").alias("content"))
    return content.expand_refs(texts, store, "doc_id")


@query("SELECT doc_id, h AS content_hash, doc_id = min(doc_id) OVER (PARTITION BY h) AS is_new FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def content_dedup(spark, d):
    return content.dedup_flags(docs(spark, d))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS reference_count, CAST(max(length(text) // 4) AS BIGINT) AS token_count FROM documents GROUP BY 1")
def content_refcount(spark, d):
    return content.content_store(docs(spark, d))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return content.exact_duplicates(docs(spark, d))


@query("WITH s AS (SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT sha256(text) AS content_hash, count(*) AS k FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT content_hash, n - coalesce(k, 0) AS reference_count FROM s LEFT JOIN g USING (content_hash) WHERE n > coalesce(k, 0)")
def content_release(spark, d):
    gone = docs(spark, d).where("doc_id % 2 = 0").select(fx.content_hash("text").alias("content_hash"), F.lit(1).alias("n"))
    return content.release(content.content_store(docs(spark, d)), gone).select("content_hash", "reference_count")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS reference_count FROM documents GROUP BY 1")
def content_merge(spark, d):
    parts = [content.content_store(docs(spark, d).where(f"doc_id % 2 = {i}")) for i in (0, 1)]
    return content.merge_store(*parts).drop("token_count")


def listing(spark, d):
    return docs(spark, d).select(F.format_string("src/%s/%d.md", "source", "doc_id").alias("path"), fx.content_hash("text").alias("sha256"), F.col("n_chars").alias("size"), F.col("doc_id").alias("indexed_at"))


LISTING = "l AS (SELECT 'src/' || source || '/' || doc_id || '.md' AS path, sha256(text) AS sha256, n_chars AS size, doc_id AS indexed_at FROM documents)"


@query(f"WITH {LISTING} SELECT path, sha256 FROM l WHERE indexed_at % 3 <> 0")
def ingest_antijoin(spark, d):
    rows = listing(spark, d)
    old = rows.where("indexed_at % 3 != 2").withColumn("sha256", F.when(F.col("indexed_at") % 3 == 1, F.lit("stale")).otherwise(F.col("sha256")))
    return files.ingest_plan(rows, old).select("path", "sha256")


@query(f"WITH {LISTING} SELECT path, size + 1 AS size, indexed_at + 1 AS indexed_at FROM l WHERE indexed_at % 5 = 0 UNION ALL SELECT path, size, indexed_at FROM l WHERE indexed_at % 5 <> 0")
def manifest_upsert(spark, d):
    rows = listing(spark, d).select("path", "size", "indexed_at")
    return files.upsert_manifest(rows, rows.where("indexed_at % 5 = 0").select("path", F.col("size") + 1, F.col("indexed_at") + 1).toDF("path", "size", "indexed_at"))


@query("SELECT user_id AS session_id, max_by(event_type, ts) AS agent, max_by(nullif(props, ''), ts) AS system_prompt FROM events GROUP BY 1")
def session_upsert(spark, d):
    rows = src.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("agent"), F.col("props").alias("system_prompt"), F.lit("").alias("model_id"), "ts")
    half = F.to_timestamp(F.lit("2024-01-15"))
    last = [content.upsert_last(rows.where(c).limit(0), rows.where(c), ["session_id"], "ts").withColumnRenamed("ts", "updated_at") for c in (F.col("ts") < half, F.col("ts") >= half)]
    return content.upsert_sessions(*last).select("session_id", "agent", "system_prompt")


@query("WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT n.doc_id, max(o.doc_id) AS existing_id FROM b n LEFT JOIN b o ON n.h = o.h AND o.doc_id % 2 = 0 WHERE n.doc_id % 2 = 1 GROUP BY n.doc_id")
def buffer_dedup(spark, d):
    rows = docs(spark, d).select("doc_id", F.lit("a").alias("agent_id"), fx.content_hash("text").alias("content_hash"), F.lit("docs").alias("content_type"), F.lit("semantic").alias("strategy"), F.lit(1000).alias("chunk_size"), F.lit(100).alias("overlap"))
    old = rows.where("doc_id % 2 = 0").withColumn("buffer_id", F.col("doc_id")).withColumn("created_at", F.col("doc_id"))
    return content.existing_buffers(rows.where("doc_id % 2 = 1"), old).select("doc_id", "existing_id")


@query("SELECT CAST(place AS BIGINT) AS place, CAST(doc_id AS BIGINT) AS doc_id FROM (VALUES (0, 42), (1, 7), (3, 99)) t(place, doc_id)")
def ordered_multiget(spark, d):
    return content.multi_get(docs(spark, d), [42, 7, -5, 99], "doc_id").select("place", "doc_id")


@query("SELECT doc_id, source AS s, CASE WHEN doc_id % 2 = 0 THEN lang || '!' ELSE lang END AS l, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS extra FROM documents")
def merge_metadata(spark, d):
    rows = docs(spark, d)
    items = rows.select("doc_id", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("metadata"))
    updates = rows.where("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("lang"), F.concat("lang", F.lit("!")), F.lit("extra"), F.lit("new")).alias("metadata"))
    m = F.col("metadata")
    return content.merge_metadata(items, updates, "doc_id").select("doc_id", m["source"].alias("s"), m["lang"].alias("l"), F.try_element_at(m, F.lit("extra")).alias("extra"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("documents", "conversations", "embeddings", "pages", "benchmark", "labels", "events")))
def table_counts(spark, d):
    return files.table_counts({t: src.table(spark, d, t) for t in ("documents", "conversations", "embeddings", "pages", "benchmark", "labels", "events")})


# --- scalar functions


@query(f"SELECT doc_id, {PREVIEW.format('text')} AS preview FROM documents")
def preview_420(spark, d):
    return docs(spark, d).select("doc_id", fx.preview("text").alias("preview"))


@query(f"SELECT conv_id, turn, CAST({o.TOKENS.format('text')} AS BIGINT) AS tokens FROM conversations")
def token_estimate(spark, d):
    return convs(spark, d).select("conv_id", "turn", fx.tokens("text").alias("tokens"))


@query("SELECT conv_id, turn, role AS as_turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'assistant' END AS as_message, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS as_case FROM conversations")
def role_normalise(spark, d):
    return convs(spark, d).select("conv_id", "turn", fx.role_of_turn("role").alias("as_turn"), fx.role_of_message("role").alias("as_message"), fx.role_of_case("role").alias("as_case"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(toml|json|ya?ml|ini)$') THEN 'config' ELSE 'docs' END AS content_type, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM pages")
def content_type(spark, d):
    return src.table(spark, d, "pages").select("page_id", fx.content_type("url").alias("content_type"), fx.safe_id("url").alias("safe"))


NOTED = "n AS (SELECT doc_id, text || ' see file_' || substr(sha256(text), 1, 8) || ' and rlm_chunk:' || doc_id || '/a.b. then message:m' || (doc_id % 10) || ' file_' || substr(sha256(text), 1, 8) || chr(10) || '[LCM File IDs: file_abcdef]' AS t FROM documents)"


def noted(spark, d, text="text"):
    """Documents with references in them, which the supplied texts lack."""
    ref = F.concat(F.lit("file_"), F.substring(fx.content_hash("text"), 1, 8))
    return docs(spark, d).select("doc_id", F.concat(text, F.lit(" see "), ref, F.lit(" and rlm_chunk:"), F.col("doc_id").cast("string"), F.lit("/a.b. then message:m"), (F.col("doc_id") % 10).cast("string"), F.lit(" "), ref, F.lit("\n[LCM File IDs: file_abcdef]")).alias("t"))


@query(f"WITH {NOTED} SELECT doc_id, 'file_' || substr(sha256(text), 1, 8) || ',file_abcdef' AS ids FROM n JOIN documents USING (doc_id)")
def file_ids_extract(spark, d):
    return noted(spark, d).select("doc_id", F.array_join(fx.file_ids("t"), ",").alias("ids"))


@query("SELECT doc_id, 'rlm_chunk:' || doc_id || '/a.b,message:m' || (doc_id % 10) AS refs FROM documents")
def source_refs_extract(spark, d):
    return noted(spark, d).select("doc_id", F.array_join(fx.source_refs("t"), ",").alias("refs"))


@query(f"WITH {NOTED} SELECT doc_id, regexp_replace(t, '\\n*\\[LCM File IDs:[^\\[\\]]*\\]\\s*$', '') AS stripped FROM n")
def footer_strip(spark, d):
    return noted(spark, d).select("doc_id", fx.strip_footers("t").alias("stripped"))


@query("SELECT doc_id, 'ltm_' || substr(sha256(source || chr(31) || 'doc' || chr(31) || doc_id), 1, 32) AS item_id, 'session-' || substr(sha256(source), 1, 24) AS session_key FROM documents")
def stable_ids(spark, d):
    return docs(spark, d).select("doc_id", fx.stable_id("ltm_", "source", F.lit("doc"), "doc_id").alias("item_id"), fx.session_key("source").alias("session_key"))


# --- chunks


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, CAST(strlen(substr(text, 1, char_start)) AS BIGINT) AS byte_start, CAST(1 + length(substr(text, 1, char_start)) - length(replace(substr(text, 1, char_start), chr(10), '')) AS BIGINT) AS start_line, sha256(substr(text, char_start + 1, char_end - char_start)) AS content FROM chunks")
def chunk_documents(spark, d):
    c = chunking.chunk_documents(docs(spark, d))
    return c.select("doc_id", "chunk_index", "char_start", "char_end", "byte_start", "start_line", fx.content_hash("content").alias("content"))


@query(f"WITH RECURSIVE {o.chunk_ctes(2000, 0)} SELECT doc_id, count(*) AS chunks, CAST(sum(char_end - char_start) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS overlap_chars FROM chunks GROUP BY doc_id")
def chunk_stats(spark, d):
    return chunking.chunk_stats(chunking.chunk_documents(docs(spark, d), size=2000, overlap=0))


@query("SELECT doc_id, true AS lossless FROM documents")
def chunk_lossless(spark, d):
    return chunking.lossless(chunking.chunk_documents(docs(spark, d)), docs(spark, d))


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)}, ck AS (SELECT doc_id, chunk_index, substr(text, char_start + 1, char_end - char_start) AS text FROM chunks), {o.bm25_ctes('ck', 'doc_id, chunk_index', ASKED)} {o.top('scored', 'query_id', 'doc_id, chunk_index', 10)}")
def chunk_search(spark, d):
    # chunks go straight into the index, which takes their place on disk
    return index(spark, d, "chunks", ["doc_id", "chunk_index"], "content", lambda: chunking.chunk_documents(docs(spark, d))).search(asked(spark), ["doc_id", "chunk_index"], 10)


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)} SELECT doc_id, CAST(chunk_index // 4 AS BIGINT) AS batch_index, count(*) AS chunks, CAST(min(chunk_index) AS BIGINT) AS first_chunk FROM chunks GROUP BY ALL")
def dispatch_batches(spark, d):
    c = chunking.batches(chunks(spark, d), ["doc_id"], ["chunk_index"], 4)
    return c.groupBy("doc_id", "batch_index").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("first_chunk"))


def runs(spark, d):
    c = chunking.batches(chunks(spark, d), ["doc_id"], ["chunk_index"], 4)
    return c, mapreduce.run_batches(c)


RUNS = f"{o.chunk_ctes(1000, 100)}, b AS (SELECT doc_id, chunk_index // 4 AS batch_index, count(*) AS chunks FROM chunks GROUP BY ALL)"


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)}, w AS (SELECT doc_id, chunk_index, array_to_string(regexp_extract_all(substr(text, char_start + 1, char_end - char_start), '\\S+')[1:12], ' ') AS t FROM chunks), b AS (SELECT doc_id, chunk_index // 4 AS batch_index, count(*) AS chunks, greatest(1, length(string_agg(t, chr(10) ORDER BY chunk_index)) // 4) AS tokens FROM w GROUP BY ALL) SELECT doc_id, count(*) AS batches, CAST(0 AS BIGINT) AS failed, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS retries, CAST(1.0 AS DOUBLE) AS coverage FROM b GROUP BY doc_id")
def run_metrics(spark, d):
    c, r = runs(spark, d)
    want = c.groupBy("doc_id").agg((F.max("batch_index") + 1).alias("expected"))
    return mapreduce.run_metrics(r, want)


@query(f"WITH RECURSIVE {RUNS} SELECT doc_id, count(*) + 1 AS expected, count(*) AS found, CAST(count(*) AS VARCHAR) AS missing, CASE WHEN doc_id % 40 = 0 THEN '0' ELSE '' END AS duplicates FROM b GROUP BY doc_id")
def batch_completeness(spark, d):
    c, r = runs(spark, d)
    want = c.groupBy("doc_id").agg((F.max("batch_index") + 2).alias("batches"))
    twice = r.unionByName(r.where("batch_index = 0 and doc_id % 40 = 0"))
    out = mapreduce.completeness(twice, want)
    return out.select("doc_id", "expected", "found", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), F.array_join(F.col("duplicates").cast("array<string>"), ",").alias("duplicates"))


@query(f"WITH RECURSIVE {RUNS} SELECT doc_id, count(*) AS batches, CAST(sum(chunks) AS BIGINT) AS n_chunks FROM b GROUP BY doc_id")
def run_aggregate(spark, d):
    return mapreduce.aggregate(runs(spark, d)[1]).select("doc_id", "batches", F.size("chunk_ids").cast("long").alias("n_chunks"))


# --- sessions


@query(f"WITH {o.MESSAGES} SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens + 5) AS BIGINT) AS context_tokens, max(turn) AS last_turn FROM m GROUP BY session_id")
def session_stats(spark, d):
    return session.session_stats(msgs(spark, d))


@query(f"WITH {o.MESSAGES} SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY session_id")
def session_token_count(spark, d):
    return session.session_stats(msgs(spark, d)).select("session_id", "tokens")


SMALL = session.Budget(limit=1200, output=150, buffer=50)


@query(f"WITH {o.MESSAGES}, s AS (SELECT session_id, CAST(sum(tokens + 5) AS BIGINT) AS context_tokens FROM m GROUP BY session_id) SELECT *, context_tokens >= 600 AS soft_overflow, context_tokens >= 1000 AS hard_overflow FROM s")
def threshold_assess(spark, d):
    return session.assess(session.session_stats(msgs(spark, d)), SMALL).select("session_id", "context_tokens", "soft_overflow", "hard_overflow")


@query(f"WITH {o.MESSAGES}, s AS (SELECT session_id, CAST(sum(tokens + 5) AS BIGINT) AS t FROM m GROUP BY session_id ORDER BY session_id DESC LIMIT 50) SELECT session_id, t AS context_tokens, CASE WHEN t >= 1000 THEN 'hard_overflow' ELSE 'soft_overflow' END AS reason FROM s WHERE t >= 600")
def compaction_due(spark, d):
    return session.compaction_due(session.session_stats(msgs(spark, d)), SMALL, newest_sessions=50).select("session_id", "context_tokens", "reason")


TAIL = f"t AS (SELECT *, tokens + 5 AS cost, CAST(sum(tokens + 5) OVER (PARTITION BY session_id ORDER BY position DESC) AS BIGINT) AS running FROM m)"


@query(f"WITH {o.MESSAGES}, {TAIL} SELECT session_id, turn, cost, running, running = cost AND cost > {BUDGET} AS is_cut FROM t WHERE running <= {BUDGET} OR (running = cost AND cost > {BUDGET})")
def budget_tail(spark, d):
    return session.budget_tail(msgs(spark, d), BUDGET).select("session_id", "turn", "cost", "running", "is_cut")


@query(f"WITH {o.MESSAGES}, t AS (SELECT *, tokens + 5 AS cost, CAST(sum(tokens + 5) OVER (PARTITION BY session_id ORDER BY position) AS BIGINT) AS running FROM m), r AS (SELECT *, CASE WHEN running > {BUDGET} AND running - cost <= {BUDGET} THEN greatest(0, {BUDGET} - (running - cost) - 5) END AS room FROM t) SELECT session_id, turn, cost, running, CAST(room AS BIGINT) AS room FROM r WHERE running <= {BUDGET} OR room > 0")
def budget_prefix(spark, d):
    return session.budget_prefix(msgs(spark, d), BUDGET).select("session_id", "turn", "cost", "running", F.col("room").cast("long").alias("room"))


@query(f"WITH {o.MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS c FROM m), u AS (SELECT session_id, i, row_number() OVER (PARTITION BY session_id ORDER BY i DESC) AS k FROM n WHERE role = 'user'), p AS (SELECT n.*, least(c - 2, coalesce((SELECT max(i) FROM u WHERE u.session_id = n.session_id AND k = 2), c)) AS start FROM n) SELECT session_id, turn FROM p WHERE c > 2 AND i < start")
def compaction_candidates(spark, d):
    return session.candidates(msgs(spark, d), 2).select("session_id", "turn")


@query(f"WITH {o.MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS c FROM m), x AS (SELECT session_id, i, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM n WHERE i = 0 OR i = c - 1 OR (c > 2 AND i = c // 2) OR i >= c - 5 + CASE WHEN c > 2 THEN 3 WHEN c = 2 THEN 2 ELSE 1 END) SELECT session_id, i AS index FROM x WHERE k <= 5")
def context_anchors(spark, d):
    return session.anchors(msgs(spark, d), 5).select("session_id", "index")


PRUNED = """p AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY position DESC) AS users FROM m),
f AS (SELECT *, role = 'system' AND users >= 1 AS fit FROM p), r AS (SELECT *, CAST(sum(CASE WHEN fit THEN tokens ELSE 0 END) OVER (PARTITION BY session_id ORDER BY position DESC) AS BIGINT) AS tool_tokens FROM f),
g AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS total FROM r WHERE fit AND tool_tokens > 20)"""


@query(f"WITH {o.MESSAGES}, {PRUNED} SELECT session_id, turn, tool_tokens FROM g WHERE total > 10")
def tool_prune(spark, d):
    rows = src.parts(msgs(spark, d)).withColumn("part_index", F.lit(0))
    return session.prune_tools(rows, protect_tokens=20, least=10, recent_user_turns=1).select("session_id", "turn", "tool_tokens")


@query(f"WITH {o.MESSAGES} SELECT session_id, 'message' AS item_type, CAST(turn AS VARCHAR) AS item_id, position FROM m WHERE turn >= 2 UNION ALL SELECT session_id, 'summary', 's' || session_id, min(position) FROM m WHERE turn < 2 GROUP BY session_id")
def context_view_after_swap(spark, d):
    m = msgs(spark, d)
    items = m.select("session_id", F.lit("message").alias("item_type"), F.col("turn").cast("string").alias("item_id"), "position")
    swaps = m.where("turn < 2").select("session_id", F.col("turn").cast("string").alias("item_id"), F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("summary_id"))
    return content.swap_context(items, swaps)


@query(f"WITH {o.MESSAGES} SELECT session_id, position, 'message' AS item_type, role, tokens FROM m WHERE turn >= 2 UNION ALL SELECT session_id, min(position), 'summary', 'assistant', CAST(sum(tokens) // 2 AS BIGINT) FROM m WHERE turn < 2 GROUP BY session_id")
def context_view(spark, d):
    m = msgs(spark, d)
    sums = m.where("turn < 2").groupBy("session_id").agg(F.floor(F.sum("tokens") / 2).cast("long").alias("tokens")).select("session_id", F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("summary_id"), F.lit("x").alias("content"), "tokens")
    return session.context_view(context_view_after_swap(spark, d), m, sums).drop("text")


COMPACTED = f"""n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS c FROM m),
a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) AS k FROM n WHERE i = 0 OR i = c - 1 OR (c > 2 AND i = c // 2) OR i >= c - 8 + CASE WHEN c > 2 THEN 3 WHEN c = 2 THEN 2 ELSE 1 END),
l AS (SELECT session_id, string_agg('- #' || i || ' ' || role || ': ' || substr(text, 1, 300), chr(10) ORDER BY i) AS lines FROM a WHERE k <= 8 GROUP BY session_id),
z AS (SELECT session_id, count(*) AS covered, min_by(turn, position) AS span_start, max_by(turn, position) AS span_end, sum(tokens + 5) AS cost FROM m GROUP BY session_id),
y AS (SELECT z.*, '[L3 DETERMINISTIC COMPACTION — ' || covered || ' messages]' || chr(10) || chr(10) || chr(10) || 'Context Anchors:' || chr(10) || lines AS content FROM z JOIN l USING (session_id))"""


@query(f"WITH {o.MESSAGES}, {COMPACTED} SELECT session_id, sha256(content) AS content, CAST(length(content) // 4 AS BIGINT) AS tokens, covered, span_start, span_end, covered = 1 OR length(content) // 4 + 5 < cost AS shrinks FROM y")
def l3_compaction(spark, d):
    return summary.compact(msgs(spark, d)).select("session_id", fx.content_hash("content").alias("content"), "tokens", "covered", "span_start", "span_end", "shrinks")


def contexts(spark, d):
    """Contexts whose first two turns are summaries, one each."""
    m = msgs(spark, d)
    first = F.col("turn") < 2
    item = F.concat(F.when(first, "s").otherwise("m"), F.col("session_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    tokens = F.when(first, fx.tokens(summary.node_text(item, F.col("text")))).otherwise(F.col("tokens"))
    return m.select("session_id", "position", F.when(first, "summary").otherwise("message").alias("item_type"), item.alias("item_id"), F.when(first, "assistant").otherwise(F.col("role")).alias("role"), "text", tokens.alias("tokens"), F.when(first, 0).otherwise(-1).cast("long").alias("level"), F.col("turn").cast("string").alias("span_start"), F.col("turn").cast("string").alias("span_end"))


CONTEXTS = f"""v0 AS (SELECT *, CASE WHEN turn < 2 THEN 's' ELSE 'm' END || session_id || '_' || turn AS id FROM m),
v1 AS (SELECT session_id, position, CASE WHEN turn < 2 THEN 'summary' ELSE 'message' END AS kind, id, CASE WHEN turn < 2 THEN 'assistant' ELSE role END AS role, text,
 CAST(CASE WHEN turn < 2 THEN {o.TOKENS.format("('[LCM summary node ' || id || ']' || chr(10) || text)")} ELSE tokens END AS BIGINT) AS tokens, CASE WHEN turn < 2 THEN 0 ELSE -1 END AS level, CAST(turn AS VARCHAR) AS a, CAST(turn AS VARCHAR) AS b FROM v0)"""
TIGHT = session.Budget(limit=450, output=50, buffer=0)
ROUNDS = f"{o.MESSAGES}, {CONTEXTS}, {o.compaction_ctes(3, TIGHT.soft)}, made AS (" + " UNION ALL ".join(f"SELECT round, session_id, level, a, b, content, id, nodes, tokens FROM new{r}" for r in (1, 2, 3)) + ")"


@query(f"""WITH {ROUNDS} SELECT b0.session_id, before, before >= {TIGHT.soft} AS triggered, CAST(f.after AS BIGINT) AS after, coalesce(k, 0) AS rounds, coalesce(k, 0) > 0 AND f.after < before AS effective, coalesce(ids, '') AS summaries FROM b0
 JOIN (SELECT session_id, sum(tokens + 5) AS after FROM v4 GROUP BY 1) f USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS k, string_agg(id, ',' ORDER BY round) AS ids FROM made GROUP BY 1) USING (session_id)""")
def compaction_rounds(spark, d):
    report = summary.compact_context(contexts(spark, d), TIGHT)[2]
    return report.select("session_id", "before", "triggered", "after", "rounds", "effective", F.array_join("summaries", ",").alias("summaries"))


@query(f"WITH {ROUNDS} SELECT session_id, id AS summary_id, CAST(round AS BIGINT) AS round, CAST(level AS BIGINT) AS level, a AS span_start, b AS span_end, sha256(content) AS content, CAST(tokens AS BIGINT) AS tokens FROM made")
def compaction_summaries(spark, d):
    made = summary.compact_context(contexts(spark, d), TIGHT)[1]
    return made.select("session_id", "summary_id", "round", "level", "span_start", "span_end", fx.content_hash("content").alias("content"), "tokens")


@query(f"WITH {ROUNDS} SELECT session_id, position, kind AS item_type, id AS item_id, CAST(tokens AS BIGINT) AS tokens FROM v4")
def compaction_view(spark, d):
    return summary.compact_context(contexts(spark, d), TIGHT)[0].select("session_id", "position", "item_type", "item_id", "tokens")


@query(f"WITH {o.MESSAGES}, {CONTEXTS}, t AS (SELECT session_id, CAST(sum(tokens + 5) AS BIGINT) AS before FROM v1 GROUP BY 1) SELECT session_id, before, before >= {TIGHT.soft} AND before < {TIGHT.hard} AS deferred, before >= {TIGHT.hard} AS triggered FROM t")
def compaction_deferral(spark, d):
    return summary.compact_context(contexts(spark, d), TIGHT, rounds=0, defer_soft=True)[2].select("session_id", "before", "deferred", "triggered")


PROMPT, LIMIT = "Answer from what is known, and say where it stands.", 150
_MARK = "(chr(10) || chr(10) || '[LCM {0} truncated for context budget; source_id=' || id || ']')"
_NODE = "('[LCM summary node ' || id || ']' || chr(10) || text)"


@query(f"""WITH {o.MESSAGES}, {CONTEXTS}, h AS (SELECT {LIMIT} - {len(PROMPT) // 4} AS room),
s1 AS (SELECT session_id, position, id, {_NODE} AS text, tokens, sum(tokens + 5) OVER (PARTITION BY session_id ORDER BY position) AS running FROM v1 WHERE kind = 'summary'),
s2 AS (SELECT *, running <= room AS whole, room - (running - tokens - 5) - 5 AS rest FROM s1, h), s3 AS (SELECT session_id, position, id, NOT whole AS is_cut, CASE WHEN whole THEN text ELSE {o.fitted('text', _MARK.format('summary'), 'rest')} END AS text FROM s2 WHERE whole OR rest > 0 AND running - tokens - 5 <= room),
s AS (SELECT *, {o.TOKENS.format('text')} AS tokens FROM s3 WHERE text IS NOT NULL), us AS (SELECT session_id, sum(tokens + 5) AS used FROM s GROUP BY 1),
r1 AS (SELECT session_id, position, id, role, text, tokens, sum(tokens + 5) OVER (PARTITION BY session_id ORDER BY position DESC) AS running, greatest(0, room - coalesce(used, 0)) AS left_ FROM v1 LEFT JOIN us USING (session_id), h WHERE kind = 'message'),
r2 AS (SELECT *, running = tokens + 5 AND running > left_ AS is_cut FROM r1), r3 AS (SELECT session_id, position, id, role, is_cut, CASE WHEN NOT is_cut THEN text WHEN left_ > 5 THEN {o.fitted('text', _MARK.format('raw message'), '(left_ - 5)')} END AS text FROM r2 WHERE running <= left_ OR is_cut),
al AS (SELECT DISTINCT session_id, -1 AS position, 'system' AS source, 'system' AS id, 'system' AS role, '{PROMPT}' AS text, false AS is_cut FROM v1 UNION ALL SELECT session_id, position, 'summary', id, 'assistant', text, is_cut FROM s UNION ALL SELECT session_id, position, 'message', id, role, text, is_cut FROM r3 WHERE text IS NOT NULL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY position) AS place, source, id AS source_id, role, sha256(text) AS text, CAST({o.TOKENS.format('text')} AS BIGINT) AS tokens, is_cut FROM al""")
def context_build(spark, d):
    rows = contexts(spark, d)
    rows = rows.withColumn("text", F.when(F.col("item_type") == "summary", summary.node_text(F.col("item_id"), F.col("text"))).otherwise(F.col("text")))
    return session.build_context(rows, LIMIT, PROMPT).withColumn("text", fx.content_hash("text"))


DAG = f"""{o.MESSAGES}, n0 AS (SELECT session_id, (position - 1) // 2 AS g, min(turn) AS a, max(turn) AS b, sum(tokens) AS t FROM m GROUP BY ALL),
n1 AS (SELECT session_id, g // 2 AS g, min(a) AS a, max(b) AS b, sum(t) // 2 AS t FROM n0 GROUP BY ALL), n2 AS (SELECT session_id, g // 2 AS g, min(a) AS a, max(b) AS b, sum(t) // 2 AS t FROM n1 GROUP BY ALL),
ns AS (SELECT 'n' || session_id || '_0_' || g AS node_id, session_id, 0 AS level, g, a, b, t FROM n0 UNION ALL SELECT 'n' || session_id || '_1_' || g, session_id, 1, g, a, b, t FROM n1 UNION ALL SELECT 'n' || session_id || '_2_' || g, session_id, 2, g, a, b, t FROM n2),
ed AS (SELECT p.node_id AS parent, c.node_id AS child FROM ns p JOIN ns c ON p.session_id = c.session_id AND p.level = c.level + 1 AND p.g = c.g // 2)"""


def dag(spark, d):
    return summary.build_dag(msgs(spark, d), 2, 2, 2)


@query(f"WITH {DAG} SELECT node_id, CAST(level AS BIGINT) AS level, a AS span_start, b AS span_end, CAST(t AS BIGINT) AS tokens FROM ns")
def dag_condense(spark, d):
    return dag(spark, d).select("node_id", "level", "span_start", "span_end", "tokens")


@query(f"WITH {DAG} SELECT node_id FROM ns WHERE node_id NOT IN (SELECT child FROM ed)")
def dag_active_frontier(spark, d):
    return summary.frontier(dag(spark, d)).select("node_id")


@query(f"WITH {DAG} SELECT parent AS ancestor, child AS descendant, CAST(1 AS BIGINT) AS depth FROM ed UNION ALL SELECT x.parent, y.child, 2 FROM ed x JOIN ed y ON x.child = y.parent")
def dag_lineage(spark, d):
    return summary.lineage(spark, dag(spark, d))


# --- lifecycle


def items(spark, d):
    return src.long_term_items(docs(spark, d), src.table(spark, d, "labels"))


@query("SELECT event_id, epoch_us(lead(ts) OVER w) AS valid_to, lead(event_id) OVER w AS superseded_by, lag(event_id) OVER w AS supersedes FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)")
def scd2_merge_key(spark, d):
    rows = lifecycle.merge_key_versions(src.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id")
    return rows.select("event_id", F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to"), "superseded_by", "supersedes")


@query("WITH e AS (SELECT doc_id AS new_id, doc_id - 1 AS old_id FROM documents WHERE doc_id % 3 = 1) SELECT doc_id AS item_id, (SELECT CAST(max(new_id) AS BIGINT) FROM e WHERE old_id = doc_id) AS superseded_by, (SELECT max(old_id) FROM e WHERE new_id = doc_id) AS supersedes, CASE WHEN doc_id IN (SELECT old_id FROM e WHERE new_id IN (SELECT doc_id FROM documents)) THEN 100 END AS valid_to FROM documents")
def explicit_supersession(spark, d):
    none = F.lit(None).cast("array<bigint>")
    rows = docs(spark, d).select(F.col("doc_id").alias("item_id"), F.lit("a").alias("agent_id"), none.alias("superseded_by"), none.alias("supersedes"), F.lit(None).cast("int").alias("valid_to"))
    edges = docs(spark, d).where("doc_id % 3 = 1").select(F.col("doc_id").alias("new_id"), (F.col("doc_id") - 1).alias("old_id"))
    out = lifecycle.supersede(rows, edges, F.lit(100))
    return out.select("item_id", F.array_max("superseded_by").alias("superseded_by"), F.array_max("supersedes").alias("supersedes"), "valid_to")


@query("WITH c AS (SELECT doc_id, 'corr_' || substr(sha256(doc_id || chr(31) || 'fixed ' || doc_id), 1, 32) AS by_id FROM documents WHERE doc_id % 50 = 0) SELECT CAST(d.doc_id AS VARCHAR) AS item_id, CASE WHEN by_id IS NULL THEN 'medium' ELSE 'low' END AS confidence, by_id AS superseded_by, CASE WHEN by_id IS NOT NULL THEN d.doc_id + 1 END AS valid_to FROM documents d LEFT JOIN c USING (doc_id) UNION ALL SELECT by_id, 'high', NULL, NULL FROM c")
def correction_fold(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("item_id"), F.lit("memory").alias("source_type"), "text", F.lit("medium").alias("confidence"), F.lit(None).cast("long").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    fixes = docs(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("wrong_id"), F.concat(F.lit("fixed "), F.col("doc_id").cast("string")).alias("statement"), (F.col("doc_id") + 1).alias("at"))
    return lifecycle.correct(rows, fixes).select("item_id", "confidence", "superseded_by", "valid_to")


def claims(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("claim_id"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 2, F.lit(-1).cast("long"))).alias("item_id"))


CLAIMS = "cl AS (SELECT c.doc_id AS claim_id, d.doc_id AS item_id FROM documents c JOIN documents d ON d.doc_id IN (c.doc_id + 1, c.doc_id + 2))"


@query(f"WITH {CLAIMS}, a AS (SELECT claim_id AS item_id, string_agg(item_id, ',' ORDER BY item_id) AS contradicts FROM cl GROUP BY claim_id), b AS (SELECT item_id, string_agg(claim_id, ',' ORDER BY claim_id) AS contradicted_by FROM cl GROUP BY item_id) SELECT item_id, contradicts, contradicted_by FROM a FULL JOIN b USING (item_id)")
def contradiction_links(spark, d):
    rows = lifecycle.contradict(docs(spark, d).select(F.col("doc_id").alias("item_id")), claims(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("item_id", text("contradicts"), text("contradicted_by"))


@query(f"WITH {CLAIMS}, i AS (SELECT claim_id AS item_id FROM cl UNION SELECT item_id FROM cl), s AS (SELECT doc_id AS item_id, doc_id * 10 AS indexed_at, CAST(1 + len(list_intersect(['the', 'des', 'and'], regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS BIGINT) AS score FROM documents WHERE doc_id IN (SELECT item_id FROM i)) SELECT item_id, score, indexed_at FROM s WHERE score > 1 ORDER BY score DESC, indexed_at DESC LIMIT 15".replace("{{", "{").replace("}}", "}"))
def find_contradictions(spark, d):
    links = lifecycle.contradict(docs(spark, d).select(F.col("doc_id").alias("item_id")), claims(spark, d))
    return lifecycle.find_contradictions(links, items(spark, d), "the des and", 15)


SCORE = "round(1.0 + CASE source_type WHEN 'correction' THEN 4.0 WHEN 'contradiction' THEN 1.5 ELSE 0.0 END + CASE confidence WHEN 'high' THEN 0.5 WHEN 'low' THEN -3.0 ELSE 0.0 END + CASE WHEN controller_ignored THEN -10.0 ELSE 0.0 END + CASE WHEN superseded_by IS NOT NULL THEN -4.0 ELSE 0.0 END + CASE WHEN supersedes IS NOT NULL THEN 0.35 ELSE 0.0 END, 6)"


@query(f"WITH {o.ITEMS} SELECT item_id, CAST({SCORE} AS DOUBLE) AS score FROM items")
def active_recall_score(spark, d):
    return lifecycle.active_scores(items(spark, d)).select("item_id", "score")


ACTIVE_RECALL = f"{o.ITEMS}, ne AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY indexed_at DESC, item_id) AS k FROM items), sc AS (SELECT *, CAST({SCORE} AS DOUBLE) AS score FROM ne WHERE k <= 64), ar AS (SELECT agent_id, item_id, score, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC, indexed_at DESC, item_id) AS rank FROM sc WHERE score > 0)"


@query(f"WITH {ACTIVE_RECALL} SELECT * FROM ar WHERE rank <= 8")
def active_recall(spark, d):
    return lifecycle.active_recall(items(spark, d)).select("agent_id", "item_id", "score", "rank")


# --- hook sessions


def hooks(spark, d):
    return src.hook_events(src.table(spark, d, "events"))


@query(f"WITH {o.HOOKS}, l AS (SELECT *, lag(kind) OVER w IS DISTINCT FROM kind AS fresh FROM h WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)), i AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS BIGINT) AS island FROM l) SELECT session_id, island, kind, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM i GROUP BY ALL")
def event_coalesce(spark, d):
    return sessions.coalesced(hooks(spark, d))


PENDING = f"""{o.HOOKS}, k AS (SELECT * FROM h WHERE kind <> 'other'), x AS (SELECT t.*, e.event_id AS end_id, e.kind AS end_kind, e.ts AS end_ts, row_number() OVER (PARTITION BY t.event_id ORDER BY e.ts, e.event_id) AS n FROM k t LEFT JOIN k e ON e.session_id = t.session_id AND e.kind IN ('stop', 'discard') AND (e.ts, e.event_id) >= (t.ts, t.event_id))"""


@query(f"WITH {PENDING} SELECT session_id, end_id AS commit_id, event_id, kind, row_number() OVER (PARTITION BY session_id, end_id ORDER BY ts, event_id) AS place FROM x WHERE n = 1 AND end_kind = 'stop' AND epoch_us(end_ts) - epoch_us(ts) <= 86400000000")
def pending_commit(spark, d):
    return sessions.committed_turns(hooks(spark, d))


@query(f"WITH {PENDING} SELECT session_id, event_id FROM x WHERE n = 1 AND end_id IS NULL AND kind IN ('prompt', 'tool') AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) > 86400000000")
def pending_ttl(spark, d):
    return sessions.expired_turns(hooks(spark, d), "2024-02-01 00:00:00")


# --- evaluation and bundles


def nearest(q):
    return f"max(CASE WHEN i = round_even((n - 1) * {q}, 0) THEN value END)"


LATENCY = f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg, min(value) AS min, {nearest(0.5)} AS p50, {nearest(0.95)} AS p95, max(value) AS max FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type"


@query(LATENCY)
def latency_metrics(spark, d):
    return evaluate.latency(src.table(spark, d, "events"), ["event_type"], "value")


@query(f"WITH l AS ({LATENCY}) SELECT event_type, p50, p95, p50 <= 50 AS p50_ok, p95 <= 100 AS p95_ok FROM l")
def performance_targets(spark, d):
    return evaluate.meets(latency_metrics(spark, d), {"p50": 50, "p95": 100}).select("event_type", "p50", "p95", "p50_ok", "p95_ok")


@query("SELECT b.item_id, d.doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS char_start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def answer_evidence(spark, d):
    return evaluate.containing(docs(spark, d), src.table(spark, d, "benchmark"))


@query("SELECT b.item_id AS case_id, count(d.doc_id) AS hits, count(d.doc_id) > 0 AS found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def answer_contains_eval(spark, d):
    cases = src.table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("answer"))
    hits = answer_evidence(spark, d).join(docs(spark, d), "doc_id").select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return evaluate.answers_found(hits, cases)


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)}, sp AS (SELECT b.item_id, d.doc_id, strpos(d.text, b.text) - 1 AS a, strpos(d.text, b.text) - 1 + length(b.text) AS z FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, item_id FROM chunks JOIN sp USING (doc_id) WHERE char_start < z AND a < char_end")
def evidence_overlap(spark, d):
    spans = answer_evidence(spark, d).join(src.table(spark, d, "benchmark"), "item_id").select("doc_id", "item_id", F.col("char_start").alias("start"), (F.col("char_start") + F.char_length("text")).alias("end"))
    return evaluate.overlapping(chunks(spark, d), spans).select("doc_id", "chunk_index", "item_id")


@query(f"WITH {o.MESSAGES}, {TAIL} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY position) AS place, 'message' AS source, 'message:' || session_id || ':' || turn AS ref, role, CAST(least(tokens, {BUDGET}) AS BIGINT) AS tokens FROM t WHERE running <= {BUDGET} OR (running = cost AND cost > {BUDGET})")
def bundle_messages(spark, d):
    return bundle.bundle_messages(msgs(spark, d), BUDGET)


@query(f"""WITH {STREAMS}, {ACTIVE}, {ENSEMBLE}, {ACTIVE_RECALL}, {o.MESSAGES}, {TAIL},
u AS (SELECT 'active' AS source, 'item:' || item_id AS ref, score, 0 AS i FROM ar WHERE rank <= 8 UNION ALL SELECT 'recall', 'item:' || id, fused, 1 FROM en JOIN documents ON doc_id = id WHERE rank <= 10
 UNION ALL SELECT 'message', 'message:' || session_id || ':' || turn, 0.0, 2 FROM t WHERE running <= {BUDGET} OR (running = cost AND cost > {BUDGET}))
SELECT source, ref, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY i, score DESC) AS n FROM u) WHERE n = 1""")
def bundle_provenance(spark, d):
    return bundle.provenance(bundle_messages(spark, d), recall_with_content(spark, d), active_recall(spark, d))


_COST = "length('[' || en.rank || '] ' || id || chr(10) || {0} || chr(10))"


@query(f"""WITH {STREAMS}, {ACTIVE}, {ENSEMBLE}, hit AS (SELECT query_id, en.rank, {_COST.format('text')} AS c0, {_COST.format(f"CASE WHEN champion_of IS NULL THEN {PREVIEW.format('text')} ELSE text END")} AS c1, {_COST.format('substr(text, 1, 720)')} AS c2, {_COST.format(PREVIEW.format('text'))} AS c3 FROM en JOIN documents ON doc_id = id WHERE rank <= 10),
run AS (SELECT query_id, sum(c3) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM hit), opt AS (SELECT query_id, 0 AS i, 'full' AS policy, sum(c0) // 4 AS tokens FROM hit GROUP BY 1 UNION ALL SELECT query_id, 1, 'champion', sum(c1) // 4 FROM hit GROUP BY 1 UNION ALL SELECT query_id, 2, 'snippet', sum(c2) // 4 FROM hit GROUP BY 1 UNION ALL SELECT query_id, 3, 'preview', sum(c3) // 4 FROM hit GROUP BY 1
 UNION ALL SELECT query_id, 4, 'trimmed', max(c) // 4 FROM run WHERE c // 4 <= 2000 GROUP BY 1 UNION ALL SELECT DISTINCT query_id, 5, 'none', 0 FROM hit) SELECT query_id, arg_min(policy, i) AS policy, CAST(arg_min(tokens, i) AS BIGINT) AS tokens FROM opt WHERE tokens <= 2000 GROUP BY query_id""")
def bundle_policy(spark, d):
    hits = recall_with_content(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("full")), "id")
    hits = hits.withColumn("champion", F.when(F.col("champion_of").isNotNull(), F.col("full")).otherwise(F.col("preview"))).withColumn("snippet", F.substring("full", 1, 720))
    return bundle.choose_policy(hits, 2_000)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid recall for a batch of queries: lexical and vector rankings, fused, champions first, with previews."""
    return recall_with_content(spark, sf_dir)


from . import facade as _facade  # noqa: E402, F401  (these register queries that build on those above)
from . import sources as _sources  # noqa: E402, F401
