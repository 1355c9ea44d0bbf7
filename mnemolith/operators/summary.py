"""Deterministic compaction of sessions into summaries, and the lineage of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.sources.tables import cut

from .session import OVERHEAD, Budget, anchors, assess, candidates

#: A summary over so many tokens is cut at its last line end.
MAX_TOKENS = 7_200


def compact(messages: DataFrame) -> DataFrame:
    """One summary for each session from all its messages: (session_id, summary_id, content, tokens, covered, span_start, span_end, file_ids, shrinks).

    The summary names the messages by their anchors and keeps every file id; shrinks is false where it would cost as much as
    what it stands for, unless that is a single message.
    """
    chosen = anchors(messages)
    line = F.concat(F.lit("- #"), F.col("index").cast("string"), F.lit(" "), F.col("role"), F.lit(": "), F.substring("text", 1, 300))
    shown = chosen.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"]), "\n").alias("_lines"))
    ids = messages.select("session_id", "position", fx.file_ids("text").alias("_f"))
    stats = messages.groupBy("session_id").agg(F.count("*").alias("covered"), F.min_by("turn", "position").alias("span_start"), F.max_by("turn", "position").alias("span_end"), F.sum(F.col("tokens") + OVERHEAD).alias("_cost"))
    files = ids.groupBy("session_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "_f"))), lambda x: x["_f"]))).alias("file_ids"))
    rows = stats.join(shown, "session_id").join(files, "session_id")
    # fixed value: the head of a deterministic summary
    head = F.concat(F.lit("[L3 DETERMINISTIC COMPACTION — "), F.col("covered").cast("string"), F.lit(" messages]\n\n\nContext Anchors:\n"))
    whole = F.concat(head, F.col("_lines"))
    cut = F.substring(whole, 1, MAX_TOKENS * 4)
    whole = F.when(F.char_length(whole) > MAX_TOKENS * 4, F.regexp_replace(cut, r"\n[^\n]*\z", "")).otherwise(whole)
    rows = rows.withColumn("content", fx.add_footers(whole, F.col("file_ids"), F.array().cast("array<string>")))
    rows = rows.withColumn("tokens", F.floor(F.char_length("content") / 4).cast("long"))
    return rows.select("session_id", fx.stable_id("sum_", "session_id", "span_start", "span_end").alias("summary_id"), "content", "tokens", "covered", "span_start", "span_end", "file_ids", ((F.col("covered") == 1) | (F.col("tokens") + OVERHEAD < F.col("_cost"))).alias("shrinks"))


def leaves(messages: DataFrame, size: int) -> DataFrame:
    """(session_id, node_id, level, span_start, span_end, tokens, children, file_ids): a leaf for each run of size messages."""
    rows = messages.withColumn("_g", F.floor((F.col("position") - 1) / size).cast("long"))
    out = rows.groupBy("session_id", "_g").agg(F.min("turn").alias("span_start"), F.max("turn").alias("span_end"), F.sum("tokens").alias("tokens"))
    node = F.concat(F.lit("n"), F.col("session_id").cast("string"), F.lit("_0_"), F.col("_g").cast("string"))
    return out.select("session_id", node.alias("node_id"), F.lit(0).cast("long").alias("level"), F.col("_g").alias("place"), "span_start", "span_end", "tokens", F.array().cast("array<string>").alias("children"))


def condense(nodes: DataFrame, fan: int) -> DataFrame:
    """Parents over runs of fan nodes of one level: tokens are halved, spans joined, children kept in order."""
    rows = nodes.withColumn("_g", F.floor(F.col("place") / fan).cast("long"))
    out = rows.groupBy("session_id", "level", "_g").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.floor(F.sum("tokens") / 2).cast("long").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"]).alias("children"))
    level = F.col("level") + 1
    node = F.concat(F.lit("n"), F.col("session_id").cast("string"), F.lit("_"), level.cast("string"), F.lit("_"), F.col("_g").cast("string"))
    return out.select("session_id", node.alias("node_id"), level.alias("level"), F.col("_g").alias("place"), "span_start", "span_end", "tokens", "children")


def build_dag(messages: DataFrame, size: int = 2, fan: int = 2, levels: int = 3) -> DataFrame:
    """All nodes of a summary DAG: leaves, then parents level by level."""
    level = leaves(messages, size)
    out = level
    for _ in range(levels):
        level = condense(level, fan)
        out = out.unionByName(level)
    return out


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("parent"), F.explode("children").alias("child"))


def recursive_parents(nodes: DataFrame) -> DataFrame:
    """(session_id, node_id, level, span_start, span_end, tokens, children, kind): for each session a node over all its active nodes that leaves them active."""
    active = frontier(nodes)
    rows = active.groupBy("session_id").agg((F.max("level") + 1).alias("level"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.floor(F.sum("tokens") / 2).cast("long").alias("tokens"), F.array_sort(F.collect_list("node_id")).alias("children"))
    return rows.select("session_id", F.concat(F.lit("r"), F.col("session_id").cast("string")).alias("node_id"), "level", "span_start", "span_end", "tokens", "children", F.lit("recursive").alias("kind"))


def active_summaries(nodes: DataFrame) -> DataFrame:
    """The frontier in order for each session: higher levels first, then the later span; adds place."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("level"), F.desc("span_end"), "node_id")).cast("long")
    return frontier(nodes).withColumn("place", place)


def find_by_ref(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, node_id): nodes whose source_refs name a ref, by membership and not by text; refs: (ref)."""
    return nodes.select("node_id", F.explode("source_refs").alias("ref")).join(refs.select("ref").distinct(), "ref").distinct()


def leaf_nodes(spans: DataFrame) -> DataFrame:
    """Leaves from spans (session_id, span_start, span_end, content, file_ids, source_refs): ids by span, given and found file ids and refs, canonical footers, tokens."""
    ids = F.array_union(F.coalesce("file_ids", F.array().cast("array<string>")), fx.file_ids("content"))
    refs = F.array_union(F.coalesce("source_refs", F.array().cast("array<string>")), fx.source_refs(fx.strip_footers("content")))
    rows = spans.withColumn("file_ids", ids).withColumn("source_refs", refs).withColumn("content", fx.add_footers("content", "file_ids", "source_refs"))
    return rows.withColumn("node_id", fx.stable_id("node_", "session_id", "span_start", "span_end")).withColumn("tokens", F.floor(F.char_length("content") / 4).cast("long"))


def frontier(nodes: DataFrame) -> DataFrame:
    """Nodes that no parent has taken in, the active ones."""
    taken = nodes.where("kind != 'recursive'") if "kind" in nodes.columns else nodes
    return nodes.join(edges(taken).select(F.col("child").alias("node_id")), "node_id", "left_anti")


def lineage(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of all pairs in the DAG, by a recursive query."""
    name = f"_edges_{id(nodes)}"
    edges(nodes).createOrReplaceTempView(name)
    return spark.sql(
        f"WITH RECURSIVE walk(ancestor, descendant, depth) AS (SELECT parent, child, CAST(1 AS BIGINT) FROM {name} "
        f"UNION ALL SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN {name} e ON w.descendant = e.parent) SELECT ancestor, descendant, depth FROM walk"
    )


def missing_children(nodes: DataFrame) -> DataFrame:
    """(parent, child) of children that are no nodes themselves."""
    return edges(nodes).join(nodes.select(F.col("node_id").alias("child")), "child", "left_anti").select("parent", "child")


def is_lossless(before, after):
    """Whether all refs of the input are in the output."""
    return F.size(F.array_except(before, after)) == 0


#: The head that a summary has in a context, and the texts that stand for one that would not shrink it.
NODE_HEAD, PREVIEW_HEAD = "[LCM summary node {}]\n", "[LCM summary node preview]\n"
REFERENCE_LEAF = "[LCM deterministic compaction: %d messages. Raw sources preserved from %s to %s.]"
REFERENCE_NODE = "[LCM deterministic condensation: %d summary nodes. Raw sources preserved from %s to %s.]"


def node_text(node_id, content):
    """A summary as it stands in a context."""
    before, after = NODE_HEAD.split("{}")
    return F.concat(F.lit(before), node_id, F.lit(after), content)


def context_cost(content):
    """What a summary of this content will cost in a context, before it has an id."""
    return fx.tokens(F.concat(F.lit(PREVIEW_HEAD), content)) + OVERHEAD


def compact_context(view: DataFrame, budget: Budget, keep: int = 2, rounds: int = 3, force: bool = False, defer_soft: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compaction of all sessions at once, in at most so many rounds: (view after, summaries made, report).

    view: (session_id, position, item_type, item_id, role, text, tokens, level, span_start, span_end), an active context: a message is its own span, of
    level -1; a summary's text is without its head. A session at its soft limit is compacted, or any with force; with defer_soft one below its hard limit
    is left for later. While a session is over its soft limit, a round summarises its messages before the recent ones, or, without any, its summaries if
    there are several; a summary that would not shrink the context gives way to a reference, and where that would not either, the session is done.
    made: (session_id, summary_id, round, level, span_start, span_end, content, tokens, children, file_ids); report: (session_id, triggered, deferred, rounds,
    before, after, effective, summaries). Rounds are a bounded loop; each cuts its lineage.
    """
    cost = F.sum(F.col("tokens") + OVERHEAD)
    state = assess(view.groupBy("session_id").agg(cost.alias("context_tokens")), budget).withColumnRenamed("context_tokens", "before")
    late = F.lit(defer_soft and not force) & F.col("soft_overflow") & ~F.col("hard_overflow")
    state = state.select("session_id", "before", late.alias("deferred"), ((F.lit(force) | F.col("soft_overflow")) & ~late).alias("triggered"))
    live, made = state.where("triggered").select("session_id"), None
    for r in range(rounds):
        now = view.join(live, "session_id", "left_semi")
        over = now.groupBy("session_id").agg(cost.alias("_now"), F.count_if(F.col("item_type") == "summary").alias("_sums"))
        over = over.where(F.lit(force) | (F.col("_now") > budget.soft)).select("session_id", "_sums")
        now = now.join(over, "session_id")
        old = candidates(now.where("item_type = 'message'"), keep)
        rest = now.where("item_type = 'summary' and _sums > 1").join(old.select("session_id").distinct(), "session_id", "left_anti")
        raw = F.when(F.col("item_type") == "message", F.col("tokens") + OVERHEAD).otherwise(context_cost(F.col("text")))
        taken = old.unionByName(rest).withColumn("turn", F.col("position")).withColumn("_raw", raw)
        about = taken.groupBy("session_id").agg(
            F.count("*").alias("_n"), F.sum("_raw").alias("_raw"), F.min("position").alias("position"), (F.max("level") + 1).alias("level"), F.min_by("span_start", "position").alias("span_start"),
            F.max_by("span_end", "position").alias("span_end"), F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"]).alias("_ids"), F.max(F.col("item_type") == "summary").alias("_nodes"),
        )
        both = compact(taken).select("session_id", F.col("content").alias("_l3"), "file_ids").join(about, "session_id")
        reference = F.when(F.col("_nodes"), F.format_string(REFERENCE_NODE, "_n", "span_start", "span_end")).otherwise(F.format_string(REFERENCE_LEAF, "_n", "span_start", "span_end"))
        fits = lambda text: (F.col("_n") == 1) | (context_cost(text) < F.col("_raw"))
        both = both.withColumn("content", F.when(fits(F.col("_l3")), F.col("_l3")).when(fits(reference), reference)).where("content is not null")
        both = both.withColumn("summary_id", fx.stable_id("sum_", "session_id", "level", "span_start", "span_end")).withColumn("tokens", fx.tokens(node_text(F.col("summary_id"), F.col("content"))))
        children = F.when(F.col("_nodes"), F.col("_ids")).otherwise(F.array().cast("array<string>"))
        new = cut(both.select("session_id", "summary_id", F.lit(r + 1).cast("long").alias("round"), "level", "span_start", "span_end", "position", "content", "tokens", children.alias("children"), "file_ids", F.col("_ids").alias("replaced"), F.col("_nodes").alias("condensed")))
        gone = new.select("session_id", F.explode("replaced").alias("item_id"), F.when(F.col("condensed"), "summary").otherwise("message").alias("item_type"))
        stands = new.select("session_id", "position", F.lit("summary").alias("item_type"), F.col("summary_id").alias("item_id"), F.lit("assistant").alias("role"), F.col("content").alias("text"), "tokens", "level", "span_start", "span_end")
        view = view.join(gone, ["session_id", "item_type", "item_id"], "left_anti").select(*stands.columns).unionByName(stands)
        live = new.select("session_id")
        made = new if made is None else made.unionByName(new)
        if r + 1 < rounds:
            if not new.limit(1).count():
                break
            view = cut(view)
    after = view.groupBy("session_id").agg(cost.alias("after"))
    report = state.join(after, "session_id")
    if made is None:
        report = report.withColumn("rounds", F.lit(0).cast("long")).withColumn("summaries", F.array().cast("array<string>"))
    else:
        ids = made.groupBy("session_id").agg(F.count("*").alias("rounds"), F.transform(F.array_sort(F.collect_list(F.struct("round", "summary_id"))), lambda x: x["summary_id"]).alias("summaries"))
        report = report.join(ids, "session_id", "left").withColumn("rounds", F.coalesce("rounds", F.lit(0))).withColumn("summaries", F.coalesce("summaries", F.array().cast("array<string>")))
    report = report.select("session_id", "triggered", "deferred", "rounds", "before", "after", ((F.col("rounds") > 0) & (F.col("after") < F.col("before"))).alias("effective"), "summaries")
    return view, made, report
