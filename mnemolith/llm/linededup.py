"""Operator 6: line dedup over the corpus, in DataFrame functions only.

Line hashes are range-partitioned together with document and position and sorted by them, so one very frequent line spreads
over many partitions; first occurrences stream out of the sorted ranges, one for a line and document, and are counted. What
comes back is a compressed keep bitmap for each document that loses lines. Text is never shuffled for counting;
small bitmaps go to the text, and only larger ones meet it in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, cut, let

MIN_DOCUMENTS = 10
MIN_CODE_POINTS = 1
#: Bitmaps up to so many bytes in all, counted as they will lie in a hash table, are broadcast to the text; more meet it in a shuffle join.
BROADCAST_BYTES = 64_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII, told by its length in bytes, takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS, keep_first: bool = False) -> DataFrame:
    """(id, text_hash, keep): for documents that lose lines, their bitmap as an array of (word, bits) in order of word.

    Bit i of word w is line 64 w + i, and 1 if it stays; words that aren't listed keep all their lines, so a bitmap is no longer than
    what its document loses. A line key of min_code_points or more found in min_documents or more distinct ids is dropped
    everywhere; rows that repeat an id count as one document. Keys are compared by 128 bits of hash. Documents that
    keep all lines have no row. Null ids count as one document. With keep_first, a key stays at its first occurrence, by
    id, hash of the text and position.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), line_keys(text).alias("_keys"))  # no text passes the explode: it would be copied for each line
    lines = base.select("_id", "_th", F.posexplode("_keys").alias("_pos", "_key"))
    lines = lines.where(F.char_length("_key") >= min_code_points).select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(7), "_key").alias("_g"))
    # cut, so that both sides of the join are exchanges of its own and the rows of a frequent line can be split among tasks
    ordered = cut(lines.repartitionByRange("_h", "_g", "_id").sortWithinPartitions("_h", "_g", "_id", "_th", "_pos"))
    # the ranges hold all rows of a line and document together and in order, so this window needs no exchange and no sort
    first = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_h", "_g", "_id").orderBy("_th", "_pos"))).where("_n = 1")
    counts = first.groupBy("_h", "_g").agg(F.count("*").alias("_docs"), F.min(F.struct("_id", "_th", "_pos")).alias("_first"))
    common = cut(counts.where(F.col("_docs") >= min_documents).select("_h", "_g", *["_first"] * keep_first))
    if keep_first:
        dropped = ordered.join(common, ["_h", "_g"]).where(~F.struct("_id", "_th", "_pos").eqNullSafe(F.col("_first")))
    else:
        dropped = ordered.join(common, ["_h", "_g"], "left_semi")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_pos") % 64).cast("int"))
    # a row that stands twice has each of its lines twice, under one bit
    words = dropped.groupBy("_id", "_th", F.floor(F.col("_pos") / 64).cast("int").alias("_word")).agg(F.bitwise_not(F.bit_or(bit)).alias("_bits"))
    return words.groupBy(F.col("_id").alias(id_col), F.col("_th").alias("text_hash")).agg(F.sort_array(F.collect_list(F.struct(F.col("_word").alias("word"), F.col("_bits").alias("bits")))).alias("keep"))


def _unpacked(keep: Column) -> Column:
    """All 64-bit words of a bitmap up to its last listed one."""
    gap = lambda x, i: x["word"] - F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1)) - 1
    return F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, i)), F.array(x["bits"]))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS, keep_first: bool = False, packed: bool = False) -> DataFrame:
    """All rows and columns of docs with _n_lines, _n_dropped and _kept_text: the lines that stay, joined by newlines.

    A null or empty text is one empty line; an empty table gives an empty result. Repeated rows are each treated alike. Any
    number of lines may go, of a text of any length, in time linear in it. With keep_first, each line stays once in the corpus.
    Columns of docs may have any names but those three; packed, they come as one struct ``_row``, and may have any.
    """
    bits = cut(keep_bitmaps(docs, id_col, text_col, min_documents, min_code_points, keep_first).select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_th"), F.col("keep").alias("_keep")))
    size = bits.agg(F.sum(F.lit(160) + 24 * F.size("_keep"))).first()[0] or 0
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_rid"), F.xxhash64(text).alias("_rth"))
    both = rows.join(F.broadcast(bits) if size <= BROADCAST_BYTES else bits.hint("shuffle_hash"), F.expr("_rid <=> _id AND _rth = _th"), "left")
    lines = F.split(F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit("")), "\n")

    def kept(x, words):
        stays = lambda _, i: F.call_function("shiftrightunsigned", F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.filter(x, stays)

    some = let(F.coalesce(_unpacked(F.col("_keep")), F.array().cast("array<bigint>")), lambda words: let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.when(F.size(words) == 0, x).otherwise(kept(x, words)).alias("kept"))))
    out = both.select("_row", some.alias("_k"))
    return out.select("_row" if packed else "_row.*", F.col("_k.n").alias("_n_lines"), (F.col("_k.n") - F.size("_k.kept")).alias("_n_dropped"), F.array_join("_k.kept", "\n").alias("_kept_text"))
