"""Fusing rankings: reciprocal ranks, champions, normalised scores and hybrid recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx

K = 60


def streams(**named: DataFrame) -> DataFrame:
    """(stream, query_id, id, rank, score) of several rankings, each with the last four columns."""
    out = None
    for name, df in named.items():
        rows = df.select(F.lit(name).alias("stream"), "query_id", "id", "rank", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def rrf(ranks: DataFrame, weights: dict[str, float], active_only: bool = False, k: int = K) -> DataFrame:
    """(query_id, id, fused, contributions): the sum of weight / (k + rank) over streams.

    Weights are shares of those of all named streams, or with active_only of the streams that found anything for the query.
    contributions maps a stream to its rank, score and share of the sum.
    """
    if sum(weights.values()) <= 0:
        raise ValueError("weights must have a positive sum")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    w = F.coalesce(F.try_element_at(table, F.col("stream")), F.lit(0.0))
    rows = ranks.withColumn("_w", w)
    if active_only:
        per = Window.partitionBy("query_id")
        seen = F.collect_set(F.struct("stream", "_w")).over(per)
        rows = rows.withColumn("_all", F.aggregate(seen, F.lit(0.0), lambda a, x: a + x["_w"]))
    else:
        rows = rows.withColumn("_all", F.lit(float(sum(weights.values()))))
    rows = rows.withColumn("contribution", F.col("_w") / F.col("_all") / (k + F.col("rank")))
    details = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", F.struct("rank", "score", F.round("contribution", 8).alias("contribution"))))))
    return rows.groupBy("query_id", "id").agg(F.round(F.sum("contribution"), 8).alias("fused"), details.alias("contributions"))


def ensemble(fused: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, fused, contributions, champion_of, rank): first the best of each stream, by stream name, then by fused score; the best k."""
    champions = ranks.where("rank = 1").groupBy("query_id", "id").agg(F.min("stream").alias("champion_of"))
    rows = fused.join(champions, ["query_id", "id"], "left")
    order = [F.col("champion_of").isNull(), F.col("champion_of"), F.desc("fused"), F.col("id")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return rows.where(F.col("rank") <= k)


def minmax(scores: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Adds normalised: scores from 0 to 1 within a group, 1 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn("_lo", low).withColumn("_hi", high).withColumn("normalised", F.when(F.col("_hi") - F.col("_lo") < 1e-9, 1.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def recall(lexical: DataFrame, vector: DataFrame, items: DataFrame, k: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Hybrid recall: both rankings fused by the streams that found anything, champions first, texts fetched last.

    lexical, vector: (query_id, id, rank, score); items: (id, text). Gives (query_id, rank, id, fused, champion_of, preview).
    """
    ranks = streams(bm25=lexical, vector=vector)
    best = ensemble(rrf(ranks, weights or {"bm25": 0.5, "vector": 0.5}, active_only=True), ranks, k)
    return best.join(items.select("id", fx.preview("text").alias("preview")), "id").select("query_id", "rank", "id", "fused", "champion_of", "preview")


def by_mode(lexical: DataFrame, vector: DataFrame, mode: str = "hybrid", k: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by one of the modes bm25, semantic (or vector) and hybrid, the last by reciprocal ranks with equal weights. lexical, vector: (query_id, id, rank, score)."""
    one = {"bm25": lexical, "semantic": vector, "vector": vector}.get(mode.lower())
    rows = one.select("query_id", "id", "score") if one is not None else rrf(streams(bm25=lexical, vector=vector), {"bm25": 1.0, "vector": 1.0}).select("query_id", "id", F.col("fused").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


#: How a hit's text is chosen.
TEXT_POLICIES = ("full", "champion", "legacy", "snippet", "preview", "auto")


def recall_text(hits: DataFrame, policy: str = "auto") -> DataFrame:
    """Adds shown: the text of a hit by policy; auto takes a champion's content, else its snippet, else its preview; content that is null falls back to the preview."""
    whole, snippet, preview = F.coalesce("content", "preview"), F.nullif(F.col("snippet"), F.lit("")), F.col("preview")
    best = F.col("champion_of").isNotNull()
    shown = {"full": whole, "legacy": whole, "champion": F.when(best, whole).otherwise(preview), "snippet": F.coalesce(snippet, preview), "preview": preview, "auto": F.when(best, whole).otherwise(F.coalesce(snippet, preview))}
    return hits.withColumn("shown", shown[policy])


def recall_diagnostics(hits: DataFrame, policy: str = "auto") -> DataFrame:
    """(query_id, id, requested_policy, effective_policy, champion, source_chars, shown_chars, truncated) of hits, whose shown text is chosen by the policy."""
    rows = recall_text(hits, policy).withColumn("_source", F.coalesce("content", "preview"))
    best = F.col("champion_of").isNotNull()
    whole = (F.col("shown") == F.col("_source")) & F.col("content").isNotNull()
    effective = F.when(whole, "full").when(F.lit(policy == "preview"), "preview").when(F.lit(policy in ("snippet", "auto")) & (F.col("shown") != F.col("preview")), "snippet").when(F.lit(policy == "champion") & best & F.col("content").isNotNull(), "full").otherwise("preview")
    n, m = F.char_length("_source").cast("long"), F.char_length("shown").cast("long")
    return rows.select("query_id", "id", F.lit(policy).alias("requested_policy"), effective.alias("effective_policy"), best.alias("champion"), n.alias("source_chars"), m.alias("shown_chars"), (m < n).alias("truncated"))


def recall_lines(hits: DataFrame, text_col: str = "shown") -> DataFrame:
    """(query_id, block): the hits of a query as numbered lines of ref, streams and score, each with its text; hits: (query_id, rank, ref, streams, score, text)."""
    names = F.when(F.size("streams") > 0, F.array_join(F.array_sort("streams"), ", ")).otherwise("index")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "ref", F.lit(" ("), names, F.lit(", score="), F.format_string("%.4f", "score"), F.lit(")\n   "), text_col)
    rows = hits.select("query_id", F.struct("rank", line.alias("t")).alias("_s")).groupBy("query_id").agg(F.array_sort(F.collect_list("_s")).alias("_all"))
    return rows.select("query_id", F.concat(F.lit("[Long-term recall: refs point to immutable raw content]\n"), F.array_join(F.transform("_all", lambda x: x["t"]), "\n")).alias("block"))


def recall_block(hits: DataFrame, text_col: str = "preview") -> DataFrame:
    """(query_id, hits, champions, chars, block): the hits of a query rendered as one text, in order of rank."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] item:"), F.col("id").cast("string"), F.lit("\n"), F.col(text_col))
    rows = hits.select("query_id", F.col("champion_of").isNotNull().alias("_c"), F.struct("rank", line.alias("t")).alias("_s"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["t"]), "\n")
    return rows.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if("_c").alias("champions"), block.alias("block")).withColumn("chars", F.char_length("block").cast("long"))
