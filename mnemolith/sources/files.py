"""Files and JSON payloads as sources: markdown trees, transcripts, session files, hook payloads and benchmark cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx

#: Folders and files that discovery passes over.
SKIPPED_FOLDERS = [".git", ".hg", ".svn", ".codex", ".venv", "venv", "env", "node_modules", "dist", "build", "__pycache__"]
SKIPPED_FILES = ["AGENTS.md"]


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_path, content) of whole text files, without byte-order marks."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_path"), F.regexp_replace("value", "^\\uFEFF", "").alias("content"))


def discover_markdown(spark: SparkSession, root: str, max_files: int = 1000, max_bytes: int = 1_000_000, min_bytes: int = 1) -> DataFrame:
    """(path, size, sha256, mtime, skipped) of markdown files under a root; skipped says why a file is left out, null if it isn't."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").load(root)
    folder = F.lit("/(" + "|".join(x.replace(".", "\\.") for x in SKIPPED_FOLDERS) + ")/")
    name = F.element_at(F.split("path", "/"), -1)
    why = F.when(F.regexp_like("path", folder), "folder").when(name.isin(SKIPPED_FILES), "name").when(F.col("length") > max_bytes, "large").when(F.col("length") < min_bytes, "small")
    rows = found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"), why.alias("skipped"))
    kept = rows.where("skipped is null").orderBy("path").limit(max_files).select("path", F.lit(True).alias("_in"))
    return rows.join(kept, "path", "left").withColumn("skipped", F.coalesce("skipped", F.when(F.col("_in").isNull(), "beyond"))).drop("_in")


def ingest_plan(listing: DataFrame, manifest: DataFrame, keys: tuple[str, ...] = ("path",), fingerprint: tuple[str, ...] = ("sha256",), items: DataFrame | None = None) -> DataFrame:
    """The rows of a listing whose fingerprint the manifest does not hold: new or changed files, or with another owner if keys say so. With items (keys), a file of which no item is left is read again."""
    held = manifest.select(*keys, *fingerprint)
    held = held.join(items.select(*keys).distinct(), list(keys), "left_semi") if items is not None else held
    return listing.join(held, [*keys, *fingerprint], "left_anti")


def tool_contents(df: DataFrame, id_col: str, text_col: str, most: int = 1600) -> DataFrame:
    """(id, payload): rows as the JSON that a tool call returns, texts clipped, with a flag and the length of what was cut."""
    cut = F.char_length(text_col) > most
    part = F.struct(F.lit("text").alias("type"), fx.clip(text_col, most).alias("text"))
    return df.select(id_col, F.to_json(F.struct(F.array(part).alias("content"), cut.alias("truncated"), F.char_length(text_col).alias("chars"))).alias("payload"))


def write_whole(df: DataFrame, path: str) -> None:
    """Writes a small table as one JSON-lines file that appears at its place in whole or not at all."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.coalesce(1).write.mode("overwrite").json(f"{path}.part")
    (made,) = [x.getPath() for x in fs.listStatus(at(f"{path}.part")) if x.getPath().getName().startswith("part-")] or [None]
    if made is None:
        fs.create(at(f"{path}.part/part-none")).close()
        made = at(f"{path}.part/part-none")
    if fs.exists(at(path)):
        fs.delete(at(path), False)
    fs.rename(made, at(path))
    fs.delete(at(f"{path}.part"), True)


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "path", order: str = "indexed_at") -> DataFrame:
    """One row for each key, the latest."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return old.unionByName(new).withColumn("_n", last).where("_n = 1").drop("_n")


def session_json(df: DataFrame, path_col: str = "path", json_col: str = "value") -> DataFrame:
    """(session_id, turn, role, content) of JSON texts that hold a list of turns or an object with turns or messages; without an id the file's name is the session."""
    raw = df.select(F.col(path_col).alias("path"), F.try_parse_json(json_col).alias("v"))
    turn = "array<struct<role string, content string>>"
    turns = F.coalesce(F.try_variant_get("v", "$.turns", turn), F.try_variant_get("v", "$.messages", turn), F.try_variant_get("v", "$", turn))
    rows = raw.select(F.coalesce(F.try_variant_get("v", "$.session_id", "string"), F.element_at(F.split("path", "/"), -1)).alias("session_id"), F.posexplode(turns).alias("turn", "t"))
    return rows.select("session_id", F.col("turn").cast("long").alias("turn"), fx.role_of_turn(F.col("t.role")).alias("role"), F.coalesce("t.content", F.lit("")).alias("content"))


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """session_json of files."""
    return session_json(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def labelled_transcript(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, content) of transcripts with lines like ``[user]: text``; lines before the first label are dropped."""
    pattern = r"^\[(user|assistant|system)\]:\s?(.*)$"
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("_line", "_text"))
    lines = lines.withColumn("_role", F.nullif(F.regexp_extract(F.lower("_text"), pattern, 1), F.lit("")))
    lines = lines.withColumn("_turn", F.sum(F.col("_role").isNotNull().cast("long")).over(Window.partitionBy(id_col).orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("_role").isNotNull(), F.regexp_replace("_text", r"(?i)^\[(user|assistant|system)\]:\s?", "")).otherwise(F.col("_text"))
    grouped = lines.where("_turn > 0").select(id_col, "_turn", "_role", F.struct("_line", said.alias("t")).alias("_s")).groupBy(id_col, "_turn").agg(F.max("_role").alias("role"), F.array_sort(F.collect_list("_s")).alias("_all"))
    return grouped.select(id_col, (F.col("_turn") - 1).alias("turn"), "role", F.trim(F.array_join(F.transform("_all", lambda x: x["t"]), "\n")).alias("content"))


def last_assistant(df: DataFrame, id_col: str, line_col: str, order_col: str) -> DataFrame:
    """(id, content): the last assistant message among JSON lines."""
    v = F.try_parse_json(line_col)
    role = F.coalesce(F.try_variant_get(v, "$.role", "string"), F.try_variant_get(v, "$.message.role", "string"))
    said = F.coalesce(F.try_variant_get(v, "$.content", "string"), F.try_variant_get(v, "$.message.content", "string"), F.try_variant_get(v, "$.text", "string"))
    rows = df.select(id_col, order_col, role.alias("_r"), said.alias("_s")).where("_r = 'assistant' and _s is not null")
    return rows.groupBy(id_col).agg(F.max_by("_s", order_col).alias("content"))


#: Names that hook payloads use for each field.
PAYLOAD_NAMES = {
    "event": ["hook_event_name", "event"],
    "session_id": ["session_id", "sessionId", "conversation_id", "conversationId", "thread_id", "threadId"],
    "prompt": ["prompt", "message", "input", "text"],
    "tool_name": ["tool_name", "toolName", "name", "tool.name", "tool"],
    "tool_call_id": ["tool_call_id", "toolCallId", "call_id", "id"],
    "tool_state": ["tool_state", "toolState", "state", "status"],
    "output": ["output", "result", "stdout", "stderr", "content"],
    "assistant_response": ["assistant_response", "assistantResponse", "assistant_output", "assistantOutput", "final_response", "finalResponse", "answer", "response", "output", "assistant"],
    "summary": ["summary", "compact_summary", "compactSummary", "content", "output"],
    "transcript_path": ["transcript_path", "transcriptPath"],
}
#: Arrays of tool calls in a payload.
TOOL_LISTS = ["tool_outputs", "toolOutputs", "tool_results", "toolResults", "tool_calls", "toolCalls"]
#: Fields that make a payload itself a tool output, and those that hold its text.
TOOL_SIGNS = ["tool_name", "toolName", "tool", "name", "output", "result"]
TOOL_OUTPUTS = ["output", "result", "stdout", "stderr", "content", "message"]
#: One name for each lifecycle event.
EVENT_NAMES = {
    "sessionstart": "session-start",
    "userpromptsubmit": "user-prompt-submit",
    "posttooluse": "post-tool-use",
    "stop": "stop",
    "precompact": "pre-compact",
    "postcompact": "post-compact",
    "subagentstop": "subagent-stop",
    "discardpending": "discard-pending",
}


def canonical_event(name) -> Column:
    plain = F.regexp_replace(F.lower(name), "[^a-z]", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv]), plain), F.lower(name))


def parse_hooks(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """The columns of df with each field of a hook payload, from whichever name it goes by; a payload that is no JSON is a prompt."""
    v = F.try_parse_json(payload_col)
    fields = {name: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{x}", "string"), F.lit("")) for x in names]) for name, names in PAYLOAD_NAMES.items()}
    fields["event"] = canonical_event(fields["event"])
    fields["prompt"] = F.when(v.isNull(), F.nullif(F.trim(payload_col), F.lit(""))).otherwise(fields["prompt"])
    return df.withColumns(fields)


def tool_turns(df: DataFrame, id_col: str, payload_col: str = "payload") -> DataFrame:
    """(id, place, tool_name, tool_call_id, tool_state, content): the tool outputs of a payload, one for each element of all its lists and one from its own fields.

    All fields of an output count, a line each; one without any is told by its arguments, and left out if it has none.
    """
    v = F.try_parse_json(payload_col)
    none = F.array().cast("array<variant>")
    lists = [F.coalesce(F.try_variant_get(v, f"$.{x}", "array<variant>"), F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{x}", "variant")).startswith("OBJECT"), F.array(F.try_variant_get(v, f"$.{x}", "variant"))), none) for x in TOOL_LISTS]
    itself = F.when(F.coalesce(*[F.try_variant_get(v, f"$.{x}", "variant").cast("string") for x in TOOL_SIGNS]).isNotNull(), F.array(v)).otherwise(none)
    rows = df.select(id_col, F.posexplode(F.concat(*lists, itself)).alias("place", "_t"))
    get = lambda x: F.nullif(F.try_variant_get("_t", f"$.{x}", "string"), F.lit(""))
    field = lambda name: F.coalesce(*[get(x) for x in PAYLOAD_NAMES[name]])
    said = F.array_join(F.array_compact(F.array(*[get(x) for x in TOOL_OUTPUTS])), "\n")
    said = F.coalesce(F.nullif(F.trim(said), F.lit("")), get("arguments"), get("input"))
    out = rows.select(id_col, F.col("place").cast("long").alias("place"), F.coalesce(get("tool_name"), get("toolName"), get("name"), get("tool.name"), get("tool.tool_name"), get("tool"), F.lit("tool")).alias("tool_name"), field("tool_call_id").alias("tool_call_id"), F.coalesce(field("tool_state"), F.lit("completed")).alias("tool_state"), said.alias("content"))
    return out.where("content is not null")


def prompt_files(prompts: DataFrame, listing: DataFrame, id_col: str, text_col: str, path_col: str = "path") -> DataFrame:
    """(id, path, place): files of a listing that prompts name, first places only."""
    words = prompts.select(id_col, F.posexplode(F.split(text_col, r"\s+")).alias("place", "_w"))
    words = words.select(id_col, "place", F.regexp_replace("_w", "^[\"'`(<\\[]+|[\"'`)>\\],;:.!?]+$", "").alias(path_col)).where(F.col(path_col).rlike(r"(?i)\.(md|markdown|txt|rst|json|toml|ya?ml)$"))
    return words.join(listing.select(path_col).distinct(), path_col, "left_semi").groupBy(id_col, path_col).agg(F.min("place").cast("long").alias("place"))


def longmemeval_turns(cases: DataFrame) -> DataFrame:
    """(question_id, session_id, session_no, date, turn, role, content, has_answer) of cases with parallel arrays of sessions, dates and ids."""
    each = cases.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_no", "s"))
    each = each.select("question_id", F.col("session_no").cast("long").alias("session_no"), F.col("s.haystack_session_ids").alias("session_id"), fx.session_date(F.col("s.haystack_dates")).alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return each.select("question_id", "session_id", "session_no", "date", F.col("turn").cast("long").alias("turn"), fx.role_of_case(F.col("t.role")).alias("role"), "t.content", F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def locomo_turns(samples: DataFrame, json_col: str = "json") -> DataFrame:
    """(sample_id, session_no, date, turn, speaker, dia_id, text) of samples whose sessions are keyed session_1, session_2 and so on."""
    said = samples.select(F.get_json_object(json_col, "$.sample_id").alias("sample_id"), F.from_json(F.get_json_object(json_col, "$.conversation"), "map<string,string>").alias("c"))
    each = said.select("sample_id", "c", F.explode(F.map_filter("c", lambda k, v: k.rlike(r"^session_\d+$"))).alias("k", "v"))
    rows = each.select("sample_id", F.regexp_extract("k", r"(\d+)", 1).cast("long").alias("session_no"), fx.session_date(F.try_element_at("c", F.concat("k", F.lit("_date_time")))).alias("date"), F.posexplode(F.from_json("v", "array<struct<speaker string, dia_id string, text string>>")).alias("turn", "t"))
    return rows.select("sample_id", "session_no", "date", F.col("turn").cast("long").alias("turn"), "t.speaker", "t.dia_id", "t.text")


def locomo_questions(samples: DataFrame, json_col: str = "json") -> DataFrame:
    """(sample_id, question_no, question, answer, category, evidence) of samples."""
    rows = samples.select(F.get_json_object(json_col, "$.sample_id").alias("sample_id"), F.posexplode(F.from_json(F.get_json_object(json_col, "$.qa"), "array<struct<question string, answer string, category long, evidence array<string>>>")).alias("question_no", "q"))
    return rows.select("sample_id", F.col("question_no").cast("long").alias("question_no"), "q.*")


def flatten_case(turns: DataFrame, case_col: str, order: tuple[str, ...], text_col: str) -> DataFrame:
    """Each line of a case with the range [char_start, char_end) it takes in the case's text, lines joined by newlines."""
    before = F.sum(F.char_length(text_col) + 1).over(Window.partitionBy(case_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long"))
    return rows.withColumn("char_end", F.col("char_start") + F.char_length(text_col))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each table, in one plan."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def stress_turns(spark: SparkSession, sessions: int, turns: int) -> DataFrame:
    """Generated sessions: a fact in each first turn, then alternate questions and answers."""
    rows = spark.range(sessions * turns).select(F.floor(F.col("id") / turns).alias("conv_id"), (F.col("id") % turns).alias("turn"))
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    text = F.when(F.col("turn") == 0, F.format_string("Session %d fact: token-%d belongs to project %d.", "conv_id", "conv_id", F.col("conv_id") % 17)).otherwise(F.format_string("Session %d turn %d talks about topic %d.", "conv_id", "turn", F.col("turn") % 5))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
