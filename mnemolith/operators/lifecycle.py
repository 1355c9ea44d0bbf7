"""Lifecycle of long-term items: supersession, corrections, contradictions and recall without a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx

#: What each property of an item adds to its active-recall score.
SCORES = {"base": 1.0, "correction": 4.0, "contradiction": 1.5, "high": 0.5, "low": -3.0, "ignored": -10.0, "stale": -4.0, "tracked": 0.35, "session": 0.35, "fresh": 0.15}


def merge_key_versions(items: DataFrame, key: list[str], version: str, id_col: str) -> DataFrame:
    """Items of one key as versions: adds valid_to, superseded_by and supersedes; those of one version don't supersede each other but all earlier ones."""
    w = Window.partitionBy(*key).orderBy(version)
    first = items.groupBy(*key, version).agg(F.min(id_col).alias("_lead"))
    steps = first.withColumn("valid_to", F.lead(version).over(w)).withColumn("superseded_by", F.lead("_lead").over(w)).withColumn("supersedes", F.lag("_lead").over(w)).drop("_lead")
    return items.join(steps, [*key, version])


def supersede(items: DataFrame, edges: DataFrame, at) -> DataFrame:
    """Items after (new_id, old_id) edges: superseded_by and supersedes arrays grow, an old item's valid_to is set where it was null."""
    edges = edges.where("new_id != old_id").distinct()
    ids = items.select("item_id", "agent_id")
    e = edges.join(ids.select(F.col("item_id").alias("new_id"), "agent_id"), "new_id").join(ids.select(F.col("item_id").alias("old_id"), "agent_id"), ["old_id", "agent_id"])
    by = e.groupBy(F.col("old_id").alias("item_id")).agg(F.array_sort(F.collect_set("new_id")).alias("_by"))
    of = e.groupBy(F.col("new_id").alias("item_id")).agg(F.array_sort(F.collect_set("old_id")).alias("_of"))
    rows = items.join(by, "item_id", "left").join(of, "item_id", "left")
    none = F.array().cast(items.schema["superseded_by"].dataType)
    return rows.withColumns(
        {
            "superseded_by": F.array_union(F.coalesce("superseded_by", none), F.coalesce("_by", none)),
            "supersedes": F.array_union(F.coalesce("supersedes", none), F.coalesce("_of", none)),
            "valid_to": F.coalesce("valid_to", F.when(F.col("_by").isNotNull(), at)),
        }
    ).drop("_by", "_of")


def correct(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """Items after corrections (wrong_id, statement, at): a high-confidence item for each, the wrong one low and out of date."""
    fix = corrections.withColumn("item_id", fx.stable_id("corr_", "wrong_id", "statement"))
    last = fix.groupBy(F.col("wrong_id").alias("item_id")).agg(F.max("at").alias("_at"), F.max_by("item_id", "at").alias("_by"))
    rows = items.join(last, "item_id", "left")
    hit = F.col("_at").isNotNull()
    rows = rows.withColumn("confidence", F.when(hit, "low").otherwise(F.col("confidence"))).withColumn("valid_to", F.coalesce("valid_to", "_at")).withColumn("superseded_by", F.when(hit, F.col("_by")).otherwise(F.col("superseded_by"))).drop("_at", "_by")
    new = fix.select("item_id", F.lit("correction").alias("source_type"), F.col("statement").alias("text"), F.lit("high").alias("confidence"), F.lit(None).cast(items.schema["valid_to"].dataType).alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    return rows.select(*new.columns).unionByName(new)


def contradict(items: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_id, contradicts, contradicted_by): links both ways from claims (claim_id, item_id); claims on unknown items are listed with null arrays.

    The caller refuses a claim that has no known item, as unknown_claims finds them.
    """
    known = claims.join(items.select("item_id"), "item_id", "left_semi").distinct()
    out = known.groupBy(F.col("claim_id").alias("item_id")).agg(F.array_sort(F.collect_set("item_id")).alias("contradicts"))
    back = known.groupBy("item_id").agg(F.array_sort(F.collect_set("claim_id")).alias("contradicted_by"))
    return out.join(back, "item_id", "full")


def unknown_claims(items: DataFrame, claims: DataFrame) -> DataFrame:
    return claims.join(items.select("item_id"), "item_id", "left_anti")


def find_contradictions(links: DataFrame, items: DataFrame, query: str | None = None, k: int = 10) -> DataFrame:
    """(item_id, score, rank) of items with contradiction links: 1 and the words shared with the query; with a query, those that share none are left out."""
    rows = links.where("size(coalesce(contradicts, array())) + size(coalesce(contradicted_by, array())) > 0").join(items.select("item_id", "text", "indexed_at"), "item_id")
    if query is None:
        rows = rows.withColumn("score", F.lit(1).cast("long"))
    else:
        shared = F.size(F.array_intersect(fx.query_words(F.lit(query)), fx.query_words("text")))
        rows = rows.withColumn("_n", shared).where("_n > 0").withColumn("score", (F.col("_n") + 1).cast("long"))
    return rows.orderBy(F.desc("score"), F.desc("indexed_at"), "item_id").limit(k).select("item_id", "score", "indexed_at")


def active_scores(items: DataFrame, session=None) -> DataFrame:
    """Adds score and reasons by an item's lifecycle: source_type, confidence, controller_ignored, superseded_by, supersedes, freshness, session_id."""
    s = SCORES
    correction, contradiction = F.col("source_type") == "correction", F.col("source_type") == "contradiction"
    high, low, ignored = F.col("confidence") == "high", F.col("confidence") == "low", F.col("controller_ignored")
    stale, tracked = F.col("superseded_by").isNotNull(), F.col("supersedes").isNotNull()
    same = (F.col("session_id") == session) if session is not None and "session_id" in items.columns else F.lit(False)
    fresh = F.col("freshness").isNotNull() if "freshness" in items.columns else F.lit(False)
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    score = F.lit(s["base"]) + F.when(correction, s["correction"]).when(contradiction, s["contradiction"]).otherwise(0.0) + yes(high, s["high"]) + yes(low, s["low"]) + yes(ignored, s["ignored"]) + yes(stale, s["stale"]) + yes(tracked, s["tracked"]) + yes(same, s["session"]) + yes(fresh, s["fresh"])
    # fixed values: the names of the reasons
    reasons = [(correction, "correction"), (contradiction, "contradiction"), (high, "high_confidence"), (low, "low_confidence"), (ignored, "controller_ignored"), (stale, "superseded_or_stale"), (tracked, "contradiction_tracking"), (same, "same_session"), (fresh, "freshness_available")]
    return items.withColumn("score", F.round(score, 6)).withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in reasons])))


def active_recall(items: DataFrame, limit: int = 8, agent: str = "agent_id", session=None) -> DataFrame:
    """For each agent the best items without a query: of the newest max(50, 8 limit), those with a positive score, best and newest first; adds rank."""
    new = items.withColumn("_new", F.row_number().over(Window.partitionBy(agent).orderBy(F.desc("indexed_at"), "item_id"))).where(F.col("_new") <= max(50, 8 * limit)).drop("_new")
    rows = active_scores(new, session).where("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(agent).orderBy(F.desc("score"), F.desc("indexed_at"), "item_id")).cast("long")).where(F.col("rank") <= limit)
