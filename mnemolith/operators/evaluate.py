"""Evaluation: latency summaries, answer matching and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.sources.tables import cut


def ranges_of_values(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, _k, _before): how often each value stands in its group, and how many are smaller.

    Values are counted in each task before they meet, dealt out in ranges, and counted again by range, so no group is sorted in one task.
    """
    n = samples.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_k"))
    dealt = cut(n.repartitionByRange(*group, value).withColumn("_p", F.spark_partition_id()))
    ahead = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*group, "_p").agg(F.sum("_k").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    inside = Window.partitionBy(*group, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_in", F.coalesce(F.sum("_k").over(inside), F.lit(0)))
    same = [rows[c].eqNullSafe(parts[c]) for c in (*group, "_p")]
    return rows.join(parts, same).select(*[rows[c] for c in group], value, "_k", (F.col("_ahead") + F.col("_in")).alias("_before"))


def latency(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, avg, min, p50, p95, max): percentiles by nearest rank, the place rounded half to even."""
    rows = ranges_of_values(samples, group, value)
    total = rows.groupBy(*group).agg(F.sum("_k").alias("n"), F.sum(F.col(value) * F.col("_k")).alias("_s"), F.min(value).alias("min"), F.max(value).alias("max"))
    both = rows.alias("r").join(total.alias("t"), [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in group])

    def at(q):
        place = F.bround((F.col("t.n") - 1) * F.lit(q))
        return F.max(F.when((F.col("r._before") <= place) & (place < F.col("r._before") + F.col("r._k")), F.col(f"r.{value}")))

    out = both.groupBy(*[F.col(f"r.{c}").alias(c) for c in group]).agg(F.max("t.n").alias("n"), F.round(F.max("t._s") / F.max("t.n"), 6).alias("avg"), F.max("t.min").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("t.max").alias("max"))
    return out


def roll_up(answers: DataFrame) -> DataFrame:
    """(answered, correct, exact_score, misses): answers (case_id, answered, correct) as totals; the score is the share of correct ones among those answered."""
    right = F.count_if(F.col("answered") & F.col("correct"))
    done = F.count_if("answered")
    return answers.agg(done.alias("answered"), right.alias("correct"), F.round(F.when(done > 0, right / done), 6).alias("exact_score"), (done - right).alias("misses"))


def meets(summary: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Adds a column name_ok for each target on a summary's column."""
    return summary.withColumns({f"{c}_ok": F.col(c) <= t for c, t in targets.items()})


def answers_found(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, hits, found): whether the joined contents of a case's hits contain the answer. hits: (case_id, rank, content); cases: (case_id, answer)."""
    said = hits.groupBy("case_id").agg(F.count("*").alias("hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("_t"))
    rows = cases.join(said, "case_id", "left")
    return rows.select("case_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(fx.answer_matches("answer", "_t"), F.lit(False)).alias("found"))


def containing(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, doc_id, char_start): documents that contain a passage, and where it first stands; an empty passage is in none.

    Passages meet documents by the hash of k code points: a passage has one at the first multiple of k in it for each
    alignment, a document one at each multiple of k; the text decides. k is 16, and half of that again and again for passages under 2 k - 1 code points,
    so that each length has its k.
    """
    size = lambda c: F.when(F.char_length(c) >= 31, 16).when(F.char_length(c) >= 15, 8).when(F.char_length(c) >= 7, 4).when(F.char_length(c) >= 3, 2).otherwise(1)
    p = passages.select(F.col(item_id), F.col(text_col).alias("_p")).where(F.char_length("_p") > 0).withColumn("_k", size("_p"))
    found = None
    for k in sorted(r[0] for r in p.select("_k").distinct().collect()):  # five at most
        own = p.where(F.col("_k") == k).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(item_id, "_p", F.xxhash64(F.substring("_p", F.col("_i"), F.lit(k))).alias("_h"))
        cells = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text_col) / k).cast("int") - 1), lambda i: F.xxhash64(F.substring(text_col, i * k + 1, F.lit(k))))  # noqa: B023
        d = docs.where(F.char_length(text_col) >= k).select(F.col(doc_id), F.explode(F.array_distinct(cells)).alias("_h"))
        meet = d.join(own, "_h").select(doc_id, item_id, "_p").distinct()
        found = meet if found is None else found.unionByName(meet)
    if found is None:
        return docs.join(p.select(item_id), F.lit(False)).select(item_id, doc_id, F.lit(0).cast("long").alias("char_start"))
    out = docs.select(F.col(doc_id), F.col(text_col).alias("_d")).join(found, doc_id).withColumn("char_start", F.expr("locate(_p, _d)").cast("long") - 1)
    return out.where("char_start >= 0").select(item_id, doc_id, "char_start")


def overlapping(chunks: DataFrame, spans: DataFrame, id_col: str = "doc_id", width: int = 1000) -> DataFrame:
    """Chunks with the spans (id, start, end) of their document that they overlap; both are dealt to cells of the given width, so the join is an equi-join."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((F.greatest(b, a + 1) - 1) / width)))
    c = chunks.withColumn("_cell", cells(F.col("char_start"), F.col("char_end")))
    s = spans.withColumn("_cell", cells(F.col("start"), F.col("end")))
    both = c.join(s, [id_col, "_cell"]).where((F.col("char_start") < F.col("end")) & (F.col("start") < F.col("char_end")))
    # a pair meets in several cells; the first that both are in counts it
    first = F.greatest(F.floor(F.col("char_start") / width), F.floor(F.col("start") / width))
    return both.where(F.col("_cell") == first).drop("_cell")


def stream_counts(ranks: DataFrame) -> DataFrame:
    """(query_id, stream, hits, champion) of rankings."""
    return ranks.groupBy("query_id", "stream").agg(F.count("*").alias("hits"), F.min_by("id", "rank").alias("champion"))


def coverage(checks: DataFrame) -> DataFrame:
    """(dimension, passed, failed): whether all checks of a dimension hold, and the names of those that don't. checks: (dimension, name, ok)."""
    return checks.groupBy("dimension").agg(F.bool_and("ok").alias("passed"), F.array_sort(F.array_compact(F.collect_list(F.when(~F.col("ok"), F.col("name"))))).alias("failed"))
