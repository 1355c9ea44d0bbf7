"""Context bundles: recall injected into a session's view within a budget, with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import budget_tail

#: What is tried in turn until a bundle fits, from most text to none.
POLICIES = ("full", "champion", "snippet", "preview", "trimmed", "none")


def block_cost(hits: DataFrame, text_col: str = "shown") -> DataFrame:
    """Adds running_chars: what the first hits of a query take when rendered, a line of rank and id and the text each."""
    n = F.char_length(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("id").cast("string"), F.lit("\n"), F.col(text_col), F.lit("\n")))
    return hits.withColumn("running_chars", F.sum(n).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def trimmed(hits: DataFrame, budget: int, text_col: str = "shown") -> DataFrame:
    """The longest run of first hits that fits the budget of tokens."""
    return block_cost(hits, text_col).where(F.floor(F.col("running_chars") / 4) <= budget)


def choose_policy(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, policy, tokens): the first policy whose block fits. hits has a column for each of full, champion, snippet and preview."""
    each = [block_cost(hits, p).groupBy("query_id").agg((F.floor(F.max("running_chars") / 4)).cast("long").alias("tokens")).withColumn("policy", F.lit(p)).withColumn("_i", F.lit(i)) for i, p in enumerate(POLICIES[:4])]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    cut = trimmed(hits, budget, "preview").groupBy("query_id").agg((F.floor(F.max("running_chars") / 4)).cast("long").alias("tokens")).withColumn("policy", F.lit("trimmed")).withColumn("_i", F.lit(4))
    none = hits.select("query_id").distinct().select("query_id", F.lit(0).cast("long").alias("tokens"), F.lit("none").alias("policy"), F.lit(5).alias("_i"))
    rows = rows.unionByName(cut).unionByName(none).where(F.col("tokens") <= budget)
    return rows.groupBy("query_id").agg(F.min_by(F.struct("policy", "tokens"), "_i").alias("_p")).select("query_id", "_p.policy", "_p.tokens")


def bundle_messages(messages: DataFrame, budget: int) -> DataFrame:
    """(session_id, place, source, ref, role, tokens) of what a bundle sends: the session's tail in order."""
    tail = budget_tail(messages, budget)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("position")).cast("long")
    return tail.select("session_id", place.alias("place"), F.lit("message").alias("source"), F.concat_ws(":", F.lit("message"), F.col("session_id").cast("string"), F.col("turn").cast("string")).alias("ref"), "role", F.least("tokens", F.lit(budget)).cast("long").alias("tokens"))


def provenance(messages: DataFrame, recalled: DataFrame, active: DataFrame) -> DataFrame:
    """(source, ref, score) of all that a bundle draws on, each ref once by the first source that has it: active, recall, message."""
    a = active.select(F.lit("active").alias("source"), F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("ref"), F.col("score").cast("double").alias("score"), F.lit(0).alias("_i"))
    r = recalled.select(F.lit("recall").alias("source"), F.concat(F.lit("item:"), F.col("id").cast("string")).alias("ref"), F.col("fused").cast("double").alias("score"), F.lit(1).alias("_i"))
    m = messages.select(F.lit("message").alias("source"), F.col("ref"), F.lit(0.0).alias("score"), F.lit(2).alias("_i"))
    rows = a.unionByName(r).unionByName(m)
    return rows.groupBy("ref").agg(F.min_by(F.struct("source", "score"), F.struct("_i", -F.col("score"))).alias("_s")).select("_s.source", "ref", "_s.score")


#: What only an audit may see of a bundle.
AUDIT = ("source", "ref", "tokens", "is_cut", "score", "reasons", "provenance", "diagnostics")


def model_payload(messages: DataFrame) -> DataFrame:
    """(session_id, payload): the messages of each bundle as JSON, the only part that a model's prompt may hold. messages: (session_id, place, role, text)."""
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", F.col("text").alias("content")))).alias("_all"))
    return rows.select("session_id", F.to_json(F.struct(F.transform("_all", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("payload"))


def audit_payload(messages: DataFrame, budget: int) -> DataFrame:
    """(session_id, token_estimate, budget, messages, summaries, truncated, raw_refs): what there is to log of each bundle, without any text."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "source", F.col("source_id").cast("string")).alias("r")))), lambda x: x["r"])
    cost = F.col("tokens") + F.when(F.col("source") == "system", 0).otherwise(5)
    return messages.groupBy("session_id").agg(F.sum(cost).cast("long").alias("token_estimate"), F.lit(budget).cast("long").alias("budget"), F.count_if(F.col("source") == "message").alias("messages"), F.count_if(F.col("source") == "summary").alias("summaries"), F.max("is_cut").alias("truncated"), refs.alias("raw_refs"))


def guarded(rows: DataFrame) -> DataFrame:
    """Rows for a model; refused if they hold a column that is for the audit."""
    if bad := sorted(set(rows.columns) & set(AUDIT)):
        raise ValueError(f"for the audit only: {bad}")
    return rows


def snapshot_events(audits: DataFrame) -> DataFrame:
    """(session_id, event, detail): the event that a built context leaves, its figures as JSON in order of name."""
    detail = F.to_json(F.struct("budget", "messages", "summaries", "token_estimate", "truncated"))
    return audits.select("session_id", F.lit("context.snapshot").alias("event"), detail.alias("detail"))
