"""Operator 3: mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source, documents stand in an order of their sizes. The expected copies of each, target / source size, are
summed along that order, one random offset of the source is added, and a document is emitted once for every
integer that the sum crosses at it. In order of size, the words taken miss the target by less than the largest document,
whatever the offset: what one size takes too much or too little, the next one gives back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Rows of one source and size are dealt to so many salts, so that no group of them meets in one task.
SALTS = 1024
#: Offsets have 20 binary places, which keeps rank * rate + offset exact where the rate is a whole number.
OFFSET_DIGITS = 5


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(_key, _source_size, _target) from (_key, _source_size), one row for a source.

    Sources in order of key take the weights in turn and share all words by them; a target stops at max_copies times
    its source's size and the excess goes to the others by weight. The sources that stop are those of
    least max_copies * size / weight, so one pass over the sources in that order finds the common level.
    """
    order = Window.orderBy("_key")
    picks = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.withColumn("_weight", picks).withColumn("_cap", max_copies * F.col("_source_size").cast("double"))
    src = src.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    all_ = Window.partitionBy()
    before = Window.orderBy("_ratio", "_key").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumns({
        "_total": F.sum("_source_size").over(all_).cast("double"),
        "_weights": F.sum("_weight").over(all_),
        "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_weight_before": F.coalesce(F.sum("_weight").over(before), F.lit(0.0)),
    })
    level = F.greatest(F.col("_total") - F.col("_cap_before"), F.lit(0.0)) / (F.col("_weights") - F.col("_weight_before"))
    src = src.withColumn("_level", F.min(F.when(F.col("_ratio") >= level, F.struct(F.col("_ratio"), F.col("_key"), level.alias("level")))).over(all_)["level"])
    return src.select("_key", "_source_size", F.least(F.col("_cap"), F.coalesce(F.col("_weight") * F.col("_level"), F.col("_cap"))).alias("_target"))


def offset_of(key: Column, seed: int) -> Column:
    """The random offset of a source, 0 to 1: the first digits of a hash of its key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, OFFSET_DIGITS), 16, 10).cast("double") / float(16**OFFSET_DIGITS)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, text_hash), one row for each row of docs.

    size: words of the text, of any length, null has 0; a null source is a source of its own, the last; copies: 0 to max_copies;
    taken: copies * size. The same rows and seed give the same copies for any partitioning; rows that share an id
    are ordered by their text, and equal rows may swap their copies, which leaves the result as a set the same.
    An empty table gives an empty result; a corpus without words takes none. Only id, text and source are read, whatever
    other columns there are. Ranks in a source are sums of counts by size and salt, so no source is sorted in one task.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("_size"), F.xxhash64(text_col).alias("_th"), F.md5(text.cast("binary")).alias("_md5"))
    key = F.coalesce(F.concat(F.lit("a"), "_source"), F.lit("b"))  # by code point, null last
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("_md5", F.lit(""))).cast("binary")), 1, 5)
    salt = F.conv(digits, 16, 10).cast("int") % SALTS
    base = cut(base.select("_id", "_source", "_size", "_th", key.alias("_key"), salt.alias("_salt")))
    cells = base.groupBy("_key", "_size", "_salt").agg(F.count("*").alias("_n"))
    groups = cells.groupBy("_key", "_size").agg(F.sum("_n").alias("_n"))
    sources = source_targets(groups.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).alias("_source_size")), weights, max_copies)
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(max_copies)), F.col("_target") / F.col("_source_size"))).otherwise(0.0)
    sources = sources.withColumn("_rate", rate).withColumn("_offset", offset_of(F.col("_key"), seed))
    below = Window.partitionBy("_key").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n").join(sources, "_key")
    below = Window.partitionBy("_key", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_in_size", F.coalesce(F.sum("_n").over(below), F.lit(0))).drop("_n").join(groups, ["_key", "_size"])
    rows = base.join(cells, ["_key", "_size", "_salt"])
    rank = F.col("_before") + F.col("_in_size") + F.row_number().over(Window.partitionBy("_key", "_size", "_salt").orderBy("_id", "_th"))
    rows = rows.withColumn("_rank", rank)
    crossed = F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset")) - F.floor((F.col("_rank") - 1) * F.col("_rate") + F.col("_offset"))
    rows = rows.withColumn("_copies", F.least(crossed, F.lit(max_copies)).cast("long"))
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_th").alias("text_hash"))
