"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing and BPE encoding over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever their
names: while a stage adds columns of its own, those of docs travel in one struct. Null ids, texts, languages and sources, empty and
very long texts, ties and repeated rows have the results that each stage's docstring says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.llm.bpe import bpe_encode
from mnemolith.llm.common import cut, table
from mnemolith.llm.jaccard import BROADCAST_IDS, jaccard_components
from mnemolith.llm.linededup import dedup_lines
from mnemolith.llm.mixing import mix_sources
from mnemolith.llm.quality import quality_rules
from mnemolith.llm.queries import word_vocabulary

#: Keys of repeated rows up to this number are broadcast.
BROADCAST_KEYS = 100_000


def packed(docs: DataFrame) -> DataFrame:
    """(_row, _id, _th): each row of docs as a struct, its id, and a hash of its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    Null, empty and other texts under 20 words go; a null language is one of its own; of repeated rows all stay or all go.
    """
    return quality_rules(docs, keep_columns=True).where("_kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share, each of which stays at its first occurrence; n_chars follows the text.

    A document that loses lines and of which nothing but white space stays goes; one that loses none stays as it is, also if its text is null or
    empty. Rows that repeat id and text lose the same lines.
    """
    out = dedup_lines(docs, keep_first=True, packed=True)
    fewer = F.col("_n_dropped") > 0
    new = {"text": F.col("_kept_text"), "n_chars": F.char_length("_kept_text")}
    out = out.where(~fewer | F.col("_kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.when(fewer, new[f.name].cast(f.dataType)).otherwise(F.col(f"_row.`{f.name}`")).alias(f.name) if f.name in new else F.col(f"_row.`{f.name}`").alias(f.name) for f in docs.schema])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; of rows that repeat both id and text, one. Near: 0.8 or more of the five-word shingles in common.

    Texts without words and null ids are near nothing and stay. Rows that share an id but not the text stay together, if one of them does.
    """
    components = jaccard_components(docs, n=5, percent=80).where("doc_id is not null")
    gone = cut(components.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("_stays")).where("not _stays").select(F.col("doc_id").alias("_gone")))
    rows, keys, same = packed(docs), ["_id", "_th"], F.expr("_id <=> _rid AND _th = _rth")
    if gone.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        # one shuffle of texts: both steps want the rows of an id together
        return rows.join(gone.hint("merge"), F.expr("_id = _gone"), "left_anti").dropDuplicates(keys).select("_row.*")
    stay = rows.join(F.broadcast(gone), F.expr("_id = _gone"), "left_anti")
    again = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_id").alias("_rid"), F.col("_th").alias("_rth")))
    if not (n := again.limit(BROADCAST_KEYS + 1).count()):
        return stay.select("_row.*")
    if n > BROADCAST_KEYS:
        return stay.dropDuplicates(keys).select("_row.*")
    # only texts of rows that repeat are shuffled
    return stay.join(F.broadcast(again), same, "left_anti").unionByName(stay.join(F.broadcast(again), same, "left_semi").dropDuplicates(keys)).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times.

    A null source is a source of its own; texts without words count nothing towards their source and are taken at its rate, null ids like others. Rows
    that repeat id and text have copies of their own, which are summed and come from one of them.
    """
    taken = mix_sources(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_tid"), F.col("text_hash").alias("_tth")).agg(F.sum("copies").alias("_copies"))
    rows = packed(docs).dropDuplicates(["_id", "_th"])
    both = rows.join(taken, F.expr("_id <=> _tid AND _th = _tth"))
    return both.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row; a null or empty text has no tokens, and repeated rows come out alike."""
    return bpe_encode(docs, word_vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("BPE encoding", encoding)]

#: The tokenizer has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
