"""Registered queries of sources, scalar functions, parts and evaluation, over inputs that are made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.operators import bundle, chunking, content, evaluate, fusion, mapreduce, parts, session, summary, vector
from mnemolith.sources import files
from mnemolith.sources import tables as src
from mnemolith.streaming import sessions

from . import oracles as o
from . import registry as r
from .registry import convs, docs, msgs, query

FOUR_WORDS = "regexp_extract_all(text, '\\S+')"


# --- files and payloads


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, trim(text) AS content FROM conversations")
def labelled_transcripts(spark, d):
    line = F.concat(F.lit("["), "role", F.lit("]: "), "text")
    t = convs(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return files.labelled_transcript(t, "conv_id", "t")


@query("SELECT CASE WHEN conv_id % 2 = 0 THEN 's' || conv_id ELSE 'c' || conv_id || '.json' END AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations")
def session_json_turns(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    rows = convs(spark, d).groupBy("conv_id").agg(turns.alias("turns"))
    named = F.to_json(F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turns").alias("messages")))
    rows = rows.select(F.format_string("in/c%d.json", "conv_id").alias("path"), F.when(F.col("conv_id") % 2 == 0, named).otherwise(F.to_json(F.struct("turns"))).alias("value"))
    return files.session_json(rows)


@query("SELECT conv_id, max_by(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_assistant_line(spark, d):
    lines = convs(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.struct("role", F.col("text").alias("content")).alias("message")))).otherwise(F.to_json(F.struct("role", F.col("text").alias("content")))).alias("line"))
    return files.last_assistant(lines, "conv_id", "line", "turn")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'user-prompt-submit' WHEN 1 THEN 'stop' END AS event, CASE WHEN event_id % 3 < 2 THEN CAST(user_id AS VARCHAR) END AS session_id, event_type AS prompt FROM events")
def hook_payloads(spark, d):
    user = F.col("user_id").cast("string")
    first = F.to_json(F.struct(F.lit("UserPromptSubmit").alias("hook_event_name"), user.alias("sessionId"), F.col("event_type").alias("prompt")))
    second = F.to_json(F.struct(F.lit("stop").alias("event"), user.alias("conversation_id"), F.col("event_type").alias("message")))
    rows = src.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, first).when(F.col("event_id") % 3 == 1, second).otherwise(F.col("event_type")).alias("payload"))
    return files.parse_hooks(rows).select("event_id", "event", "session_id", "prompt")


@query("SELECT event_id, CAST(place AS BIGINT) AS place, CASE place WHEN 0 THEN event_type WHEN 1 THEN 'tool' ELSE 'own' END AS tool_name, CASE place WHEN 1 THEN 'failed' ELSE 'completed' END AS tool_state, CASE place WHEN 0 THEN 'out' || chr(10) || 'err' WHEN 1 THEN 'args' ELSE CAST(user_id AS VARCHAR) END AS content FROM events, (VALUES (0), (1), (2)) t(place)")
def tool_payloads(spark, d):
    one = F.struct(F.col("event_type").alias("name"), F.lit("out").alias("stdout"), F.lit("err").alias("stderr"))
    two = F.struct(F.lit("failed").alias("status"), F.lit("args").alias("arguments"))
    rows = src.table(spark, d, "events").select("event_id", F.to_json(F.struct(F.array(one).alias("tool_outputs"), two.alias("toolCalls"), F.lit("own").alias("tool_name"), F.col("user_id").cast("string").alias("result"))).alias("payload"))
    return files.tool_turns(rows, "event_id").select("event_id", "place", "tool_name", "tool_state", "content")


@query("SELECT doc_id, 'src/' || source || '/' || doc_id || '.md' AS path, CAST(1 AS BIGINT) AS place FROM documents")
def prompt_file_refs(spark, d):
    path = F.format_string("src/%s/%d.md", "source", "doc_id")
    return files.prompt_files(docs(spark, d).select("doc_id", F.concat(F.lit("read `"), path, F.lit("`, then nowhere.md and "), path, F.lit(".")).alias("t")), r.listing(spark, d), "doc_id", "t")


@query("SELECT 'case' || conv_id AS sample_id, CAST(1 AS BIGINT) AS session_no, strftime(TIMESTAMP '2023-05-08 13:56:00', '%Y-%m-%d %H:%M:%S') AS date, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role AS speaker, 'D1:' || turn AS dia_id, text FROM conversations")
def locomo_turns(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("speaker"), F.concat(F.lit("D1:"), x["turn"].cast("string")).alias("dia_id"), x["text"].alias("text")))
    rows = convs(spark, d).groupBy("conv_id").agg(turns.alias("session_1"))
    rows = rows.select(F.to_json(F.struct(F.concat(F.lit("case"), F.col("conv_id").cast("string")).alias("sample_id"), F.struct("session_1", F.lit("1:56 pm on 8 May, 2023").alias("session_1_date_time")).alias("conversation"))).alias("json"))
    return files.locomo_turns(rows).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT CAST(conv_id AS VARCHAR) AS question_id, 's' || (conv_id % 3) AS session_id, CAST(0 AS BIGINT) AS session_no, '2023-05-20 02:21:00' AS date, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, text AS content, turn = 0 AS has_answer FROM conversations")
def longmemeval_turns(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.when(x["turn"] == 0, True).alias("has_answer")))
    rows = convs(spark, d).groupBy("conv_id").agg(turns.alias("t"))
    rows = rows.select(F.col("conv_id").cast("string").alias("question_id"), F.array(F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"))).alias("haystack_session_ids"), F.array(F.lit("2023/05/20 (Sat) 02:21")).alias("haystack_dates"), F.array("t").alias("haystack_sessions"))
    return files.longmemeval_turns(rows).withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT 'case' || conv_id AS sample_id, CAST(turn AS BIGINT) AS question_no, text AS question, role AS answer, CAST(turn % 5 AS BIGINT) AS category, 'D1:' || turn AS evidence FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text, role FROM conversations)")
def locomo_questions(spark, d):
    qa = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x, i: F.struct(x["text"].alias("question"), x["role"].alias("answer"), (i % 5).alias("category"), F.array(F.concat(F.lit("D1:"), i.cast("string"))).alias("evidence")))
    rows = convs(spark, d).groupBy("conv_id").agg(qa.alias("qa")).select(F.to_json(F.struct(F.concat(F.lit("case"), F.col("conv_id").cast("string")).alias("sample_id"), "qa")).alias("json"))
    return files.locomo_questions(rows).withColumn("evidence", F.array_join("evidence", ","))


@query("SELECT conv_id, turn, CAST(e - length(text) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations)")
def case_spans(spark, d):
    return files.flatten_case(convs(spark, d), "conv_id", ("turn",), "text").select("conv_id", "turn", "char_start", "char_end")


@query("SELECT s AS conv_id, t AS turn, CASE WHEN t % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN t = 0 THEN 'Session ' || s || ' fact: token-' || s || ' belongs to project ' || (s % 17) || '.' ELSE 'Session ' || s || ' turn ' || t || ' talks about topic ' || (t % 5) || '.' END AS text FROM range(100) a(s), range(12) b(t)")
def stress_sessions(spark, d):
    return files.stress_turns(spark, 100, 12)


@query("SELECT doc_id, source, lang FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang IN ('en', 'fr') AND doc_id >= 10 AND text IS NOT NULL")
def scan_by_agent(spark, d):
    rows = docs(spark, d)
    clauses = {"source": rows.agg(F.min("source")).first()[0]}
    for column, value in clauses.items():
        rows = rows.where(F.col(column) == value)
    return rows.where(F.col("lang").isin("en", "fr") & (F.col("doc_id") >= 10) & F.col("text").isNotNull()).select("doc_id", "source", "lang")


# --- messages and their parts


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def message_positions(spark, d):
    return content.positions(convs(spark, d), "conv_id").select("conv_id", "turn", "position")


KEYS = ["conv_id", "turn"]


def turn_parts(spark, d):
    """Parts of all turns: a system turn is a tool's output and a note, others are plain text."""
    tool = F.struct(F.lit("tool").alias("part_type"), F.col("text").alias("content"), F.lit("grep").alias("tool_name"), F.col("turn").cast("string").alias("tool_call_id"), F.lit("completed").alias("tool_state"))
    none = F.lit(None).cast("string")
    note = F.struct(F.lit("text").alias("part_type"), F.lit("done").alias("content"), none.alias("tool_name"), none.alias("tool_call_id"), none.alias("tool_state"))
    return parts.parts_of(convs(spark, d).withColumn("parts", F.when(F.col("role") == "system", F.array(tool, note))), KEYS)


PARTS = """pt AS (SELECT conv_id, turn, 0 AS part_index, CASE WHEN role = 'system' THEN 'tool' ELSE 'text' END AS part_type, text AS content, CASE WHEN role = 'system' THEN 'grep' END AS tool_name FROM conversations UNION ALL SELECT conv_id, turn, 1, 'text', 'done', NULL FROM conversations WHERE role = 'system'),
pi AS (SELECT *, 'part_' || substr(sha256(conv_id || chr(31) || turn || chr(31) || part_index), 1, 32) AS part_id FROM pt)"""


@query(f"WITH {PARTS} SELECT conv_id, turn, CAST(part_index AS BIGINT) AS part_index, part_id, part_type, tool_name, sha256(content) AS content FROM pi")
def message_parts(spark, d):
    return turn_parts(spark, d).select(*KEYS, "part_index", "part_id", "part_type", "tool_name", fx.content_hash("content").alias("content"))


@query(f"WITH {PARTS} SELECT conv_id, turn, string_agg(CASE part_type WHEN 'tool' THEN '[Tool grep]' || chr(10) || content ELSE content END, chr(10) ORDER BY part_index) AS text, string_agg(content, chr(10) ORDER BY part_index) AS searchable FROM pi GROUP BY ALL")
def message_texts(spark, d):
    return parts.message_texts(turn_parts(spark, d), KEYS)


@query(f"WITH {PARTS} SELECT conv_id, turn, count(*) AS n, string_agg(part_id, ',' ORDER BY part_index) AS ids FROM pi GROUP BY ALL")
def message_part_lists(spark, d):
    rows = parts.message_lists(turn_parts(spark, d), KEYS)
    return rows.select(*KEYS, F.size("parts").cast("long").alias("n"), F.array_join(F.transform("parts", lambda x: x["part_id"]), ",").alias("ids"))


@query(f"WITH {PARTS} SELECT conv_id, turn, string_agg(CASE part_type WHEN 'tool' THEN '[Tool output compacted: grep; original part_id=' || part_id || ']' ELSE content END, chr(10) ORDER BY part_index) AS text FROM pi GROUP BY ALL")
def compacted_parts(spark, d):
    rows = turn_parts(spark, d)
    marked = content.mark_compacted(rows, rows.where("part_type = 'tool'").select("part_id"), F.lit(7.0))
    return parts.message_texts(marked, KEYS).select(*KEYS, "text")


@query(f"WITH {PARTS} SELECT c.conv_id, c.turn, role, CAST(part_index AS BIGINT) AS part_index, content FROM conversations c JOIN pi ON c.conv_id = pi.conv_id AND c.turn = pi.turn")
def hydrated_parts(spark, d):
    rows = turn_parts(spark, d).withColumn("content_hash", fx.content_hash("content"))
    store = rows.select("content_hash", "content").dropDuplicates(["content_hash"])
    return parts.hydrated(convs(spark, d).select(*KEYS, "role"), rows.select(*KEYS, "part_index", "content_hash"), store, KEYS).select(*KEYS, "role", "part_index", "content")


# --- scalar functions


@query(f"SELECT doc_id, {o.fitted('text', chr(39) + ' [cut short]' + chr(39), '40')} AS fitted FROM documents")
def fitted_text(spark, d):
    return docs(spark, d).select("doc_id", session.fit_text(F.col("text"), F.lit(" [cut short]"), F.lit(40)).alias("fitted"))


@query("SELECT conv_id AS session_id, turn FROM conversations WHERE turn > 1")
def uncovered_messages(spark, d):
    m = msgs(spark, d)
    return session.uncovered(m, m.where("turn = 1").select("session_id", F.col("turn").alias("span_end")).distinct()).select("session_id", "turn")


@query("WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations), s AS (SELECT conv_id, turn, w, list_transform(list_filter(w, lambda x: length(x) > 4 AND (x LIKE '%ing' OR x LIKE '%ed' OR (x LIKE '%s' AND x NOT LIKE '%ss'))), lambda x: CASE WHEN x LIKE '%ing' THEN substr(x, 1, length(x) - 3) WHEN x LIKE '%ed' THEN substr(x, 1, length(x) - 2) ELSE substr(x, 1, length(x) - 1) END) AS t FROM w) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(w, t))), ' ') AS words FROM s")
def stemmed_words(spark, d):
    return convs(spark, d).select(*KEYS, F.array_join(F.array_sort(fx.stemmed_query_words("text")), " ").alias("words"))


SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({SQUEEZED}) > 240 THEN rtrim(substr({SQUEEZED}, 1, 239)) || '...' ELSE {SQUEEZED} END AS preview, CASE WHEN length(text) > 1600 THEN rtrim(substr(text, 1, 1600)) || ' ...' ELSE text END AS clipped FROM documents")
def preview_and_clip(spark, d):
    return docs(spark, d).select("doc_id", fx.preview("text", 240, "...").alias("preview"), fx.clip("text").alias("clipped"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def file_id_format(spark, d):
    ids = F.concat(F.lit("file_"), F.substring(fx.content_hash("text"), 1, 8), F.when(F.col("doc_id") % 2 == 0, "").otherwise("!"))
    return docs(spark, d).select("doc_id", fx.is_file_id(ids).alias("valid"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:00') AS date FROM events")
def times_of_events(spark, d):
    e = src.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    millis = F.floor(F.unix_millis("t") / 1000) * 1000
    said = F.concat(F.date_format("t", "yyyy/MM/dd"), F.lit(" ("), F.date_format("t", "E"), F.lit(") "), F.date_format("t", "HH:mm"))
    return e.select("event_id", fx.epoch_seconds(millis).alias("seconds"), fx.iso_utc(millis).alias("iso"), F.date_format(fx.session_date(said), "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE CASE WHEN a > 0 THEN '... ' ELSE '' END || trim(substr(text, a + 1, b - a), ' ') || CASE WHEN b < n THEN ' ...' ELSE '' END END AS snippet FROM (SELECT *, greatest(0, b - 100) AS a FROM (SELECT *, least(n, greatest(0, (s + e) // 2 - 50) + 100) AS b FROM (SELECT *, least(200, n) AS s, greatest(least(200, n), least(230, n)) AS e FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL))))")
def evidence_snippets(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", fx.evidence_snippet("text", F.lit(200), F.lit(230), 100).alias("snippet"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn + 10 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS batch_index FROM conversations")
def numbered_analyses(spark, d):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Findings\n Batch index: "), (F.col("turn") + 10).cast("string"), F.lit("\nmore"))).otherwise("no number")
    return mapreduce.numbered(convs(spark, d).select(*KEYS, text.alias("text")), "conv_id", "turn").select(*KEYS, "batch_index")


@query("SELECT doc_id, '{\"a\":\"' || lang || '\",\"b\":\"' || source || '\",\"c\":\"1\"}' AS json FROM documents")
def canonical_json(spark, d):
    values = F.create_map(F.lit("c"), F.lit("1"), F.lit("a"), "lang", F.lit("b"), "source")
    return docs(spark, d).where("lang is not null and source is not null").select("doc_id", fx.canonical_json(values).alias("json"))


@query("SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE event_id % 3 WHEN 0 THEN event_type || ',' || user_id WHEN 1 THEN event_type ELSE '' END AS texts, CASE WHEN event_id % 3 = 0 THEN user_id END AS number FROM events")
def coerced_values(spark, d):
    user = F.col("user_id").cast("string")
    v = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.col("event_type"), user))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("")
    rows = src.table(spark, d, "events").select("event_id", fx.string_list(v).alias("l"), F.when(F.col("event_id") % 3 == 0, user).otherwise("n/a").alias("u"))
    return rows.select("event_id", F.size("l").cast("long").alias("n"), F.array_join("l", ",").alias("texts"), F.col("u").try_cast("long").alias("number"))


@query("SELECT doc_id, 'rchunk_' || doc_id || ',rchunk_x' AS chunks, 'message:' || doc_id AS refs FROM documents")
def chunk_and_public_refs(spark, d):
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("see rlm_chunk:rchunk_"), n, F.lit(", rchunk_x and rchunk_"), n, F.lit("."))
    refs = F.array(F.lit("content:lcm-compaction-input:ab"), F.concat(F.lit("message:"), n), F.lit(""))
    return docs(spark, d).select("doc_id", F.array_join(fx.chunk_ids(text), ",").alias("chunks"), F.array_join(fx.public_refs(refs), ",").alias("refs"))


FOOTED = "f AS (SELECT doc_id, lang || ' file_' || substr(sha256(text), 1, 8) AS body, 'file_' || substr(sha256(text), 1, 8) AS id FROM documents)"


@query(f"WITH {FOOTED} SELECT doc_id, body || chr(10) || chr(10) || '[LCM File IDs: ' || id || ', file_abcdef]' || chr(10) || chr(10) || '[LCM Source Refs: message:' || doc_id || ']' AS text, body AS stripped FROM f WHERE body IS NOT NULL")
def footers_append(spark, d):
    own = F.concat(F.lit("file_"), F.substring(fx.content_hash("text"), 1, 8))
    rows = docs(spark, d).select("doc_id", F.concat("lang", F.lit(" "), own).alias("body"), own.alias("id")).where("body is not null")
    once = rows.withColumn("once", fx.add_footers("body", F.array("id"), F.array(F.lit("message:0"))))
    out = once.select("doc_id", fx.add_footers("once", F.array(F.col("id"), F.lit("file_abcdef")), F.array(F.concat(F.lit("message:"), F.col("doc_id").cast("string")))).alias("text"))
    return out.withColumn("stripped", fx.strip_footers("text"))


@query(f"WITH {FOOTED} SELECT doc_id, true AS kept, false AS lost FROM f WHERE body IS NOT NULL")
def lossless_refs(spark, d):
    own = F.concat(F.lit("file_"), F.substring(fx.content_hash("text"), 1, 8))
    rows = docs(spark, d).where("lang is not null and text is not null").select("doc_id", F.concat(F.lit("a "), own).alias("a"), own.alias("id"))
    return rows.select("doc_id", summary.is_lossless(fx.file_ids("a"), fx.file_ids(fx.add_footers(F.lit("b"), F.array("id"), F.array().cast("array<string>")))).alias("kept"), summary.is_lossless(fx.file_ids("a"), fx.file_ids(F.lit("b"))).alias("lost"))


# --- chunks, searches and what is shown of them


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, role, text AS content FROM conversations WHERE text <> ''")
def chunk_turns(spark, d):
    return chunking.chunk_turns(convs(spark, d), ["conv_id"])


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks ORDER BY doc_id, chunk_index LIMIT 20")
def chunk_listing(spark, d):
    return chunking.list_chunks(r.chunks(spark, d), "doc_id", 20).select("doc_id", "chunk_index")


MODES = f"""{r.STREAMS}, md AS (SELECT 'bm25' AS mode, query_id, id, score FROM r WHERE stream = 'bm25' UNION ALL SELECT 'semantic', query_id, id, score FROM r WHERE stream = 'vector'
 UNION ALL SELECT 'hybrid', query_id, id, round(sum(0.5 / (60 + rank)), 8) FROM r GROUP BY query_id, id), mr AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, id) AS rank FROM md)"""


@query(f"WITH {MODES} SELECT mode, query_id, id, rank FROM mr WHERE rank <= 7")
def search_modes(spark, d):
    lex, vec = r.two_streams(spark, d)
    out = None
    for mode in ("bm25", "semantic", "hybrid"):
        rows = fusion.by_mode(lex, vec, mode, 7).select(F.lit(mode).alias("mode"), "query_id", "id", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def shown_hits(spark, d):
    """Recalled documents with content, a snippet around the range 50 to 80 for every second one, and a preview."""
    rows = r.recall_with_content(spark, d).join(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    return rows.withColumn("snippet", F.when(F.col("id") % 2 == 0, fx.evidence_snippet("content", F.lit(50), F.lit(80), 60)))


_CUT = "CASE WHEN length(text) <= 60 THEN text ELSE CASE WHEN a > 0 THEN '... ' ELSE '' END || trim(substr(text, a + 1, b - a), ' ') || CASE WHEN b < length(text) THEN ' ...' ELSE '' END END"
SHOWN = f"""{r.STREAMS}, {r.ACTIVE}, {r.ENSEMBLE}, sh0 AS (SELECT query_id, en.rank, id, fused, champion_of, text, {r.PREVIEW.format('text')} AS preview, greatest(0, least(length(text), greatest(0, (least(50, length(text)) + least(80, length(text))) // 2 - 30) + 60) - 60) AS a, least(length(text), greatest(0, (least(50, length(text)) + least(80, length(text))) // 2 - 30) + 60) AS b FROM en JOIN documents ON doc_id = id WHERE rank <= 10),
sh AS (SELECT *, CASE WHEN id % 2 = 0 THEN {_CUT} END AS snippet FROM sh0)"""
_PICK = "CASE p WHEN 'full' THEN text WHEN 'legacy' THEN text WHEN 'champion' THEN CASE WHEN champion_of IS NULL THEN preview ELSE text END WHEN 'snippet' THEN coalesce(nullif(snippet, ''), preview) WHEN 'preview' THEN preview ELSE CASE WHEN champion_of IS NULL THEN coalesce(nullif(snippet, ''), preview) ELSE text END END"
_POLICIES = "(VALUES " + ", ".join(f"('{p}')" for p in fusion.TEXT_POLICIES) + ") pol(p)"


@query(f"WITH {SHOWN} SELECT query_id, id, p AS policy, sha256({_PICK}) AS shown FROM sh, {_POLICIES}")
def recall_policies(spark, d):
    out = None
    for p in fusion.TEXT_POLICIES:
        rows = fusion.recall_text(shown_hits(spark, d), p).select("query_id", "id", F.lit(p).alias("policy"), fx.content_hash("shown").alias("shown"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {SHOWN}, dg AS (SELECT *, {_PICK} AS shown FROM sh, {_POLICIES} WHERE p IN ('auto', 'champion', 'preview')) SELECT query_id, id, p AS requested_policy, CASE WHEN shown = text THEN 'full' WHEN p = 'preview' THEN 'preview' WHEN p = 'auto' AND shown <> preview THEN 'snippet' WHEN p = 'champion' AND champion_of IS NOT NULL THEN 'full' ELSE 'preview' END AS effective_policy, champion_of IS NOT NULL AS champion, length(text) AS source_chars, length(shown) AS shown_chars, length(shown) < length(text) AS truncated FROM dg")
def recall_diagnostics(spark, d):
    out = None
    for p in ("auto", "champion", "preview"):
        rows = fusion.recall_diagnostics(shown_hits(spark, d), p)
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {SHOWN}, st AS (SELECT query_id, id, string_agg(stream, ', ' ORDER BY stream) AS names FROM r GROUP BY ALL) SELECT query_id, '[Long-term recall: refs point to immutable raw content]' || chr(10) || string_agg(rank || '. item:' || id || ' (' || names || ', score=' || printf('%.4f', fused) || ')' || chr(10) || '   ' || preview, chr(10) ORDER BY rank) AS block FROM sh JOIN st USING (query_id, id) GROUP BY query_id")
def recall_lines(spark, d):
    lex, vec = r.two_streams(spark, d)
    names = fusion.streams(bm25=lex, vector=vec).groupBy("query_id", "id").agg(F.collect_list("stream").alias("streams"))
    rows = r.recall_with_content(spark, d).join(names, ["query_id", "id"])
    return fusion.recall_lines(rows.withColumn("ref", F.concat(F.lit("item:"), F.col("id").cast("string"))).withColumn("score", F.col("fused")), "preview")


@query(f"WITH {SHOWN}, tr AS (SELECT query_id, id, CAST(sum(length('[' || rank || '] ' || id || chr(10) || preview || chr(10))) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running_chars FROM sh) SELECT query_id, id, running_chars FROM tr WHERE running_chars // 4 <= 300")
def trimmed_prefix(spark, d):
    return bundle.trimmed(r.recall_with_content(spark, d), 300, "preview").select("query_id", "id", F.col("running_chars").cast("long").alias("running_chars"))


# --- contexts as payloads


@query(f"SELECT session_id, '{{\"messages\":[' || string_agg('{{\"role\":\"' || role || '\",\"content\":' || CAST(to_json(content) AS VARCHAR) || '}}', ',' ORDER BY place) || ']}}' AS payload FROM (SELECT conv_id AS session_id, turn AS place, role, text AS content FROM conversations WHERE regexp_full_match(text, '[ -.0-~]*')) GROUP BY session_id")
def model_payload(spark, d):
    rows = convs(spark, d).where(F.col("text").rlike("^[ -.0-~]*$")).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), "role", "text")
    return bundle.model_payload(bundle.guarded(rows))


@query(f"WITH c AS ({r.ORACLES['context_build']}), a AS (SELECT session_id, CAST(sum(tokens + CASE source WHEN 'system' THEN 0 ELSE 5 END) AS BIGINT) AS token_estimate, CAST({r.LIMIT} AS BIGINT) AS budget, count(*) FILTER (source = 'message') AS messages, count(*) FILTER (source = 'summary') AS summaries, bool_or(is_cut) AS truncated, string_agg(source || ':' || source_id, ',' ORDER BY place) AS raw_refs FROM c GROUP BY 1) SELECT * FROM a")
def audit_payload(spark, d):
    return bundle.audit_payload(r.context_build(spark, d), r.LIMIT).withColumn("raw_refs", F.array_join("raw_refs", ","))


@query(f"WITH a AS ({r.ORACLES.get('context_build')}), b AS (SELECT session_id, CAST(sum(tokens + CASE source WHEN 'system' THEN 0 ELSE 5 END) AS BIGINT) AS t, count(*) FILTER (source = 'message') AS m, count(*) FILTER (source = 'summary') AS s, bool_or(is_cut) AS cut FROM a GROUP BY 1) SELECT session_id, 'context.snapshot' AS event, '{{\"budget\":{r.LIMIT},\"messages\":' || m || ',\"summaries\":' || s || ',\"token_estimate\":' || t || ',\"truncated\":' || cut || '}}' AS detail FROM b")
def context_snapshot(spark, d):
    return bundle.snapshot_events(bundle.audit_payload(r.context_build(spark, d), r.LIMIT))


# --- summary nodes


@query(f"WITH {r.DAG}, fr AS (SELECT * FROM ns WHERE node_id NOT IN (SELECT child FROM ed)) SELECT session_id, 'r' || session_id AS node_id, CAST(max(level) + 1 AS BIGINT) AS level, min(a) AS span_start, max(b) AS span_end, CAST(sum(t) // 2 AS BIGINT) AS tokens, string_agg(node_id, ',' ORDER BY node_id) AS children FROM fr GROUP BY session_id")
def dag_recursive(spark, d):
    return summary.recursive_parents(r.dag(spark, d)).withColumn("children", F.array_join("children", ",")).drop("kind")


@query(f"WITH {r.DAG}, fr AS (SELECT * FROM ns WHERE node_id NOT IN (SELECT child FROM ed)) SELECT node_id, row_number() OVER (PARTITION BY session_id ORDER BY level DESC, b DESC, node_id) AS place FROM fr")
def dag_active_order(spark, d):
    nodes = r.dag(spark, d).withColumn("kind", F.lit("leaf"))
    both = nodes.unionByName(summary.recursive_parents(nodes).withColumn("place", F.lit(0).cast("long")).select(*nodes.columns))
    return summary.active_summaries(both.drop("place")).where("kind != 'recursive'").select("node_id", "session_id", F.col("level"), "span_end").transform(lambda x: summary.active_summaries(x.withColumn("children", F.array().cast("array<string>")))).select("node_id", "place")


@query(f"WITH {o.MESSAGES} SELECT 'node_' || substr(sha256(session_id || chr(31) || turn || chr(31) || turn), 1, 32) AS node_id, sha256(text || ' file_abc123' || chr(10) || chr(10) || '[LCM File IDs: file_abc123]' || chr(10) || chr(10) || '[LCM Source Refs: message:' || turn || ']') AS content, CAST(length(text || ' file_abc123' || chr(10) || chr(10) || '[LCM File IDs: file_abc123]' || chr(10) || chr(10) || '[LCM Source Refs: message:' || turn || ']') // 4 AS BIGINT) AS tokens FROM m")
def leaf_nodes(spark, d):
    return leaves(spark, d).select("node_id", fx.content_hash("content").alias("content"), "tokens")


def leaves(spark, d):
    turn = F.col("turn").cast("string")
    spans = msgs(spark, d).select("session_id", turn.alias("span_start"), turn.alias("span_end"), F.concat("text", F.lit(" file_abc123")).alias("content"), F.lit(None).cast("array<string>").alias("file_ids"), F.array(F.concat(F.lit("message:"), turn)).alias("source_refs"))
    return summary.leaf_nodes(spans)


@query(f"WITH {o.MESSAGES} SELECT 'message:' || turn AS ref, 'node_' || substr(sha256(session_id || chr(31) || turn || chr(31) || turn), 1, 32) AS node_id FROM m WHERE turn < 2")
def nodes_by_ref(spark, d):
    asked = spark.createDataFrame([("message:0",), ("message:1",), ("message:",), ("message:9999999",)], "ref string")
    return summary.find_by_ref(leaves(spark, d), asked)


# --- map and reduce, events, evaluation


@query(f"WITH RECURSIVE {r.RUNS} SELECT doc_id, batch_index, CASE WHEN chunks = 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN chunks = 1 THEN 'ValueError' END AS error_type, CAST(0 AS BIGINT) AS retries FROM b")
def run_failures(spark, d):
    def odd(texts):
        if len(texts) == 1:
            raise ValueError("a single chunk")
        return texts[0]

    c = chunking.batches(r.chunks(spark, d), ["doc_id"], ["chunk_index"], 4)
    return mapreduce.run_batches(c, odd).select("doc_id", "batch_index", "status", "error_type", "retries")


@query(f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'known' ELSE array_to_string({FOUR_WORDS}[1:12], ' ') END AS output, role = 'user' AS cached FROM (SELECT conv_id, turn, text, CASE WHEN text IN (SELECT text FROM conversations WHERE role = 'user') THEN 'user' ELSE role END AS role FROM conversations)")
def analyses_cached(spark, d):
    rows = convs(spark, d).select(*KEYS, F.col("text").alias("input"))
    known = convs(spark, d).where("role = 'user'").select(fx.content_hash("text").alias("input_hash"), F.lit("known").alias("output")).distinct()
    return mapreduce.analyse_once(rows, mapreduce.first_words, known).select(*KEYS, "output", "cached")


@query(f"WITH RECURSIVE {o.chunk_ctes(1000, 100)}, w AS (SELECT doc_id, chunk_index, array_to_string(regexp_extract_all(substr(text, char_start + 1, char_end - char_start), '\\S+')[1:12], ' ') AS t FROM chunks), b AS (SELECT doc_id, chunk_index // 4 AS batch_index, string_agg(t, chr(10) ORDER BY chunk_index) AS t, count(*) AS n FROM w GROUP BY ALL), a AS (SELECT doc_id, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, string_agg('Batch index: ' || batch_index || chr(10) || t, chr(10) || chr(10) ORDER BY batch_index) AS t FROM b GROUP BY doc_id) SELECT doc_id, sha256(t) AS text, CAST(greatest(1, length(t) // 4) AS BIGINT) AS tokens, sha256('Recursive round 2: ' || k || ' batches, ' || n || ' chunks.' || chr(10) || chr(10) || t) AS input FROM a")
def aggregate_texts(spark, d):
    whole = mapreduce.aggregate(r.runs(spark, d)[1])
    return whole.join(mapreduce.round_input(whole, 2), "doc_id").select("doc_id", fx.content_hash("text").alias("text"), "tokens", fx.content_hash("input").alias("input"))


@query(f"WITH {o.HOOKS} SELECT event_id, 'all' AS subscriber FROM h UNION ALL SELECT event_id, 'stops' FROM h WHERE kind = 'stop'")
def subscribed_events(spark, d):
    asked = spark.createDataFrame([("all", "*"), ("stops", "stop"), ("stops", "stop"), ("none", "never"), ("all", "stop")], "subscriber string, kind string")
    return sessions.subscribed(r.hooks(spark, d).select("event_id", "kind"), asked).select("event_id", "subscriber").distinct()


@query("SELECT count(*) FILTER (value IS NOT NULL) AS answered, count(*) FILTER (value IS NOT NULL AND value > 50) AS correct, round(count(*) FILTER (value > 50) / count(*) FILTER (value IS NOT NULL), 6) AS exact_score, count(*) FILTER (value IS NOT NULL AND NOT value > 50) AS misses FROM events")
def exact_scores(spark, d):
    return evaluate.roll_up(src.table(spark, d, "events").select(F.col("event_id").alias("case_id"), F.col("value").isNotNull().alias("answered"), (F.coalesce("value", F.lit(0.0)) > 50).alias("correct")))


@query("SELECT event_type AS dimension, min(value) >= 50 AS passed, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) FILTER (value < 50), '') AS failed FROM events WHERE value IS NOT NULL GROUP BY 1")
def dimension_coverage(spark, d):
    checks = src.table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("dimension"), F.col("event_id").cast("string").alias("name"), (F.col("value") >= 50).alias("ok"))
    return evaluate.coverage(checks).withColumn("failed", F.array_join("failed", ","))


@query(f"WITH {o.MESSAGES}, s AS (SELECT session_id, sum(tokens + 5) AS t FROM m GROUP BY 1) SELECT count(*) AS sessions, count(*) FILTER (t >= {r.SMALL.soft}) AS due, count(*) FILTER (t >= {r.SMALL.hard}) AS hard, count(*) FILTER (t < {r.SMALL.soft}) AS not_due FROM s")
def compaction_totals(spark, d):
    return session.due_totals(session.session_stats(msgs(spark, d)), r.SMALL)


# --- ingestion


@query(f"WITH {r.LISTING} SELECT path, sha256 FROM l WHERE indexed_at % 3 <> 0 OR indexed_at % 2 = 1")
def ingest_owned(spark, d):
    rows = r.listing(spark, d).withColumn("agent_id", F.lit("a"))
    old = rows.withColumn("agent_id", F.when(F.col("indexed_at") % 3 == 0, "a").otherwise("b"))
    items = rows.where("indexed_at % 2 = 0").select("path", "agent_id")
    return files.ingest_plan(rows, old, ("path", "agent_id"), items=items).select("path", "sha256")


@query("WITH i AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT n.doc_id AS new_id, o.doc_id AS item_id, CAST(0 AS BIGINT) AS chunk_index FROM i n JOIN i o ON n.h = o.h OR o.doc_id = n.doc_id + 1")
def existing_corpus_items(spark, d):
    rows = docs(spark, d).select("doc_id", fx.content_hash(F.coalesce("text", F.lit(""))).alias("raw_content_id"), F.lit("a").alias("agent_id"), F.lit(1000).alias("chunk_size"), F.lit(100).alias("overlap"))
    items = rows.select(F.col("doc_id").alias("item_id"), F.lit(0).cast("long").alias("chunk_index"), "agent_id", "chunk_size", "overlap", "raw_content_id", F.col("doc_id").cast("string").alias("source_path"))
    new = rows.select(F.col("doc_id").alias("new_id"), "agent_id", "chunk_size", "overlap", "raw_content_id", (F.col("doc_id") + 1).cast("string").alias("source_path"))
    return content.existing_items(items, new)


@query("SELECT doc_id, '{\"content\":[{\"type\":\"text\",\"text\":' || CAST(to_json(CASE WHEN length(t) > 30 THEN rtrim(substr(t, 1, 30)) || ' ...' ELSE t END) AS VARCHAR) || '}],\"truncated\":' || (length(t) > 30) || ',\"chars\":' || length(t) || '}' AS payload FROM (SELECT doc_id, source || ' ' || lang || repeat(' more', CAST(doc_id % 8 AS INTEGER)) AS t FROM documents) WHERE t IS NOT NULL")
def tool_contents(spark, d):
    text = F.concat("source", F.lit(" "), "lang", F.repeat(F.lit(" more"), (F.col("doc_id") % 8).cast("int")))
    return files.tool_contents(docs(spark, d).select("doc_id", text.alias("t")).where("t is not null"), "doc_id", "t", 30)


# --- vectors and recorded results


@query("SELECT DISTINCT 'm' AS model, sha256(text) AS content_hash, CAST(length(text) AS DOUBLE) AS first FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def embedding_cache(spark, d):
    rows = docs(spark, d).where("text is not null")
    held = rows.where("doc_id % 3 = 0").select(F.lit("m").alias("model"), fx.content_hash("text").alias("content_hash")).distinct()
    new, _ = vector.encode_missing(rows.select(F.col("text").alias("content")), held, lambda texts: [[len(t)] for t in texts], "m", 1)
    return new.select("model", "content_hash", F.col("embedding")[0].cast("double").alias("first"))


@query(f"WITH t AS (SELECT doc_id, unnest({o.TERMS.format('text')}) AS t FROM documents), c AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 16 AS BIGINT) AS cell, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1) SELECT doc_id, cell, round(n / l, 6) AS weight FROM c JOIN l USING (doc_id)")
def hashed_vectors(spark, d):
    rows = vector.hashed_vectors(docs(spark, d), dimensions=16).where("embedding is not null")
    return rows.select("doc_id", F.posexplode("embedding").alias("cell", "w")).where("w > 0").select("doc_id", F.col("cell").cast("long").alias("cell"), F.round("w", 6).alias("weight"))


@query(f"WITH RECURSIVE {r.RUNS} SELECT doc_id, batch_index, CASE WHEN batch_index % 2 = 0 THEN 'first' ELSE 'second' END AS analysis FROM b")
def recorded_results(spark, d):
    c = chunking.batches(r.chunks(spark, d), ["doc_id"], ["chunk_index"], 4)
    first, second = (mapreduce.run_batches(c, lambda _, x=x: x) for x in ("first", "second"))
    return mapreduce.record(first.where("batch_index % 2 = 0"), second).select("doc_id", "batch_index", "analysis")


@query("SELECT conv_id AS session_id, turn, turn + 100 AS batch_index FROM conversations WHERE role <> 'system'")
def analyses_of_run(spark, d):
    turn = F.col("turn").cast("string")
    refs = F.when(F.col("role") == "system", F.array(F.concat(F.lit("message:"), turn))).otherwise(F.array(F.concat(F.lit("rlm_chunk:"), turn), F.lit("file:a")))
    nodes = convs(spark, d).select(F.col("conv_id").alias("session_id"), "turn", F.lpad(turn, 6, "0").alias("node_id"), F.lit(0).alias("level"), F.concat(F.lit("Batch index: "), (F.col("turn") + 100).cast("string")).alias("content"), refs.alias("source_refs"))
    return mapreduce.analyses_of_run(nodes).select("session_id", "turn", "batch_index")
