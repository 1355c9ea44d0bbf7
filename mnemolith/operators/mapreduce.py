"""Map, reduce and recurse over batches of chunks, with a pluggable analyser."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolith.functions import text as fx

LIMIT_TOKENS = 8_000


def first_words(texts: list[str], n: int = 12) -> str:
    """The analyser used where none is given: the first words of each text."""
    return "\n".join(" ".join(t.split()[:n]) for t in texts)


class TransientError(Exception):
    """What an analyser raises if another try may succeed; time-outs and lost connections count as well."""


TRANSIENT = (TransientError, TimeoutError, ConnectionError)
OUTCOME = "analysis string, tokens bigint, status string, error string, error_type string, transient boolean, retries bigint"


def attempt(analyse, texts: list[str], max_retries: int) -> tuple:
    """(analysis, tokens, status, error, error_type, transient, retries): an analyser called until it succeeds or its failure isn't worth another try."""
    for retries in range(max_retries + 1):
        try:
            text = analyse(texts)
            return text, max(1, len(text) // 4) if text else 0, "ok", None, None, None, retries
        except Exception as e:  # an analyser is foreign code
            if retries == max_retries or not isinstance(e, TRANSIENT):
                return None, 0, "failed", f"{type(e).__name__}: {e}", type(e).__name__, isinstance(e, TRANSIENT), retries
    raise ValueError("max_retries must not be negative")


def run_batches(chunks: DataFrame, analyse=first_words, run_col: str = "doc_id", max_retries: int = 2) -> DataFrame:
    """(run, batch_index, chunk_ids, analysis, tokens, status, error, error_type, transient, retries): the map step; an analyser's failure is a row, not the job's end.

    chunks: (run, batch_index, chunk_index, content); a batch must fit in memory, which its size bounds. Transient failures are tried again.
    """
    both = chunks.groupBy(run_col, "batch_index").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("_all"))
    rows = both.select(run_col, F.col("batch_index").cast("long").alias("batch_index"), F.transform("_all", lambda x: x["chunk_index"]).cast("array<bigint>").alias("chunk_ids"), F.transform("_all", lambda x: x["content"]).alias("texts"))
    kind = rows.schema[run_col].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = [attempt(analyse, list(x), max_retries) for x in pdf["texts"]]
            done = pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")], index=pdf.index)
            yield pd.concat([pdf[[run_col, "batch_index", "chunk_ids"]], done], axis=1)

    return rows.mapInPandas(run, f"{run_col} {kind}, batch_index bigint, chunk_ids array<bigint>, {OUTCOME}")


def analyse_once(inputs: DataFrame, analyse, known: DataFrame | None = None, max_retries: int = 2) -> DataFrame:
    """(input_hash, output, status, error, retries, cached) for each row of inputs (input): equal inputs are analysed once, and those with an output in known (input_hash, output) not at all."""
    rows = inputs.withColumn("input_hash", fx.content_hash("input"))
    new = rows.select("input_hash", "input").dropDuplicates(["input_hash"])
    new = new.join(known.select("input_hash"), "input_hash", "left_anti") if known is not None else new

    def run(frames):
        for pdf in frames:
            out = [attempt(analyse, [x], max_retries) for x in pdf["input"]]
            yield pd.DataFrame({"input_hash": pdf["input_hash"], "output": [x[0] for x in out], "status": [x[2] for x in out], "error": [x[3] for x in out], "retries": [x[6] for x in out], "cached": False})

    made = new.mapInPandas(run, "input_hash string, output string, status string, error string, retries bigint, cached boolean")
    if known is not None:
        none = F.lit(None).cast("string")
        made = made.unionByName(known.select("input_hash", "output", F.lit("ok").alias("status"), none.alias("error"), F.lit(0).cast("long").alias("retries"), F.lit(True).alias("cached")))
    return rows.drop("input").join(made, "input_hash")


def completions(inputs: DataFrame, provider, system: str = "", max_tokens: int = 1_000, temperature: float = 0.0, known: DataFrame | None = None, max_retries: int = 2) -> DataFrame:
    """analyse_once by a model provider, any object with complete(system, user, max_tokens, temperature) that can be sent to executors."""
    return analyse_once(inputs, lambda texts: provider.complete(system, texts[0], max_tokens, temperature), known, max_retries)


class CommandRunner:
    """An analyser that is a command: it gets the texts on its standard input, parted by form feeds, and prints the analysis. A time-out is worth another try, a failure isn't."""

    def __init__(self, args: list[str], seconds: float = 60.0) -> None:
        self.args, self.seconds = args, seconds

    def __call__(self, texts: list[str]) -> str:
        try:
            done = subprocess.run(self.args, input="\f".join(texts), capture_output=True, text=True, timeout=self.seconds)
        except subprocess.TimeoutExpired as e:
            raise TransientError(str(e)) from e
        if done.returncode:
            raise RuntimeError(done.stderr.strip() or f"{self.args[0]} ended with {done.returncode}")
        return done.stdout.strip()


def record(results: DataFrame, new: DataFrame, run_col: str = "doc_id") -> DataFrame:
    """Results after new ones; what is there for a batch stays."""
    return results.unionByName(new.join(results.select(run_col, "batch_index"), [run_col, "batch_index"], "left_anti"))


def analyses_of_run(nodes: DataFrame, run_col: str = "session_id") -> DataFrame:
    """The leaves of a run that rest on chunks, in order of batch: nodes (run, node_id, level, content, source_refs) with a ``rlm_chunk:`` ref; adds batch_index, stated or ordinal."""
    own = nodes.where((F.col("level") == 0) & F.exists("source_refs", lambda r: r.startswith("rlm_chunk:")))
    return numbered(own, run_col, "node_id", "content")


def completeness(results: DataFrame, expected: DataFrame, run_col: str = "doc_id") -> DataFrame:
    """(run, expected, found, missing, duplicates, extra): batch numbers that lack, repeat or go beyond those expected. expected: (run, batches)."""
    seen = results.groupBy(run_col, "batch_index").agg(F.count("*").alias("_k")).groupBy(run_col).agg(F.collect_list(F.struct("batch_index", "_k")).alias("_s"))
    rows = expected.join(seen, run_col, "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<batch_index:bigint,_k:bigint>>")))
    have = F.transform("_s", lambda x: x["batch_index"])
    want = F.when(F.col("batches") > 0, F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_have", have).withColumn("_want", want)
    return rows.select(
        run_col, F.col("batches").alias("expected"), F.size("_have").cast("long").alias("found"), F.array_sort(F.array_except("_want", "_have")).alias("missing"),
        F.array_sort(F.transform(F.filter("_s", lambda x: x["_k"] > 1), lambda x: x["batch_index"])).alias("duplicates"), F.array_sort(F.array_except("_have", "_want")).alias("extra"),
    )


def aggregate(results: DataFrame, run_col: str = "doc_id") -> DataFrame:
    """(run, batches, chunk_ids, text, tokens): the reduce step, analyses in order of batch."""
    good = results.where("status = 'ok'").select(run_col, F.struct("batch_index", "chunk_ids", "analysis").alias("_r")).groupBy(run_col).agg(F.array_sort(F.collect_list("_r")).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x: F.concat(F.lit("Batch index: "), x["batch_index"].cast("string"), F.lit("\n"), x["analysis"])), "\n\n")
    rows = good.select(run_col, F.size("_all").cast("long").alias("batches"), F.array_distinct(F.flatten(F.transform("_all", lambda x: x["chunk_ids"]))).alias("chunk_ids"), text.alias("text"))
    return rows.withColumn("tokens", fx.tokens("text"))


def recurse(aggregates: DataFrame, analyse=first_words, limit: int = LIMIT_TOKENS, rounds: int = 3, run_col: str = "doc_id") -> DataFrame:
    """Aggregates, those over the limit analysed again, at most so many rounds; adds rounds and fits."""
    out = aggregates.withColumn("rounds", F.lit(0).cast("long"))
    kind = aggregates.schema[run_col].dataType.simpleString()

    def again(frames):
        for pdf in frames:
            for i in pdf.index:
                while pdf.at[i, "tokens"] > limit and pdf.at[i, "rounds"] < rounds:
                    parts = [p for p in pdf.at[i, "text"].split("\n\n") if p]
                    pdf.at[i, "text"] = "\n\n".join(analyse([p]) for p in parts)
                    pdf.at[i, "tokens"] = max(1, len(pdf.at[i, "text"]) // 4)
                    pdf.at[i, "rounds"] += 1
            yield pdf

    cols = out.select(run_col, "batches", "chunk_ids", "text", "tokens", "rounds")
    return cols.mapInPandas(again, f"{run_col} {kind}, batches bigint, chunk_ids array<bigint>, text string, tokens bigint, rounds bigint").withColumn("fits", F.col("tokens") <= limit)


def refused(final: DataFrame, limit: int = LIMIT_TOKENS) -> DataFrame:
    """Aggregates that are over the limit after all rounds, which a caller must not take for results."""
    return final.where(F.col("tokens") > limit)


def round_input(aggregates: DataFrame, number: int, run_col: str = "doc_id") -> DataFrame:
    """(run, input): what a further round is given, the aggregate under a line that says which round it is and what it covers."""
    head = F.concat(F.lit(f"Recursive round {number}: "), F.col("batches").cast("string"), F.lit(" batches, "), F.size("chunk_ids").cast("string"), F.lit(" chunks.\n\n"))
    return aggregates.select(run_col, F.concat(head, F.col("text")).alias("input"))


def numbered(analyses: DataFrame, run_col: str, order: str, text_col: str = "text") -> DataFrame:
    """Adds batch_index: the number that an analysis states among its first lines, else its ordinal in the run."""
    ordinal = F.row_number().over(Window.partitionBy(run_col).orderBy(order)) - 1
    return analyses.withColumn("batch_index", F.coalesce(fx.batch_index(text_col), ordinal.cast("long")))


def run_metrics(results: DataFrame, expected: DataFrame, run_col: str = "doc_id") -> DataFrame:
    """(run, batches, failed, chunks, tokens, retries, coverage): totals of a run, coverage the share of expected batches that are done."""
    r = results.groupBy(run_col).agg(F.count_if(F.col("status") == "ok").alias("batches"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum(F.size("chunk_ids")).cast("long").alias("chunks"), F.sum("tokens").alias("tokens"), F.sum("retries").alias("retries"))
    rows = expected.join(r, run_col, "left")
    return rows.select(run_col, F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("retries", F.lit(0)).alias("retries"), F.round(F.coalesce(F.col("batches"), F.lit(0)) / F.col("expected"), 6).alias("coverage"))
