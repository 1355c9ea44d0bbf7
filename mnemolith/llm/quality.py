"""Operator 5: quality rules with a distribution-divergence verdict, in DataFrame functions only.

Each document's character-class histogram and common-word histogram are compared with those of its
language by the Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). The language
references are learned from all documents; guards of minimum length hold back the verdict on short ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, store, words

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Common words of a language: its most frequent ones of at most so many code points.
COMMON_WORDS, COMMON_LENGTH = 24, 5
#: Documents below these lengths are not judged by the histogram concerned.
MIN_CLASS_CHARS, MIN_HISTOGRAM_WORDS = 150, 40
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.35
#: More references than this are joined by shuffling instead of broadcasting (each is under 1 kB).
BROADCAST_LANGUAGES = 1_000
SYMBOLS = r"[#*$%&|<>]"
#: Taken off the text one after another; what remains is the last class.
CLASSES = (("lower", r"\p{Ll}+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", r"\p{Lu}+"), ("stop", r"[.,;:'’\-]+"), ("symbol", SYMBOLS + "+"), ("digit", r"\p{Nd}+"), ("letter", r"\p{L}+"))


def _classes(docs: DataFrame) -> DataFrame:
    """Adds the length of the text in code points and the count of each character class."""
    out, rest = docs.withColumn("_n", F.char_length("_text")), "_text"
    for name, pattern in CLASSES:
        out = out.withColumn(f"_rest_{name}", F.regexp_replace(rest, pattern, "")).withColumn(f"_{name}", (F.char_length(rest) - F.char_length(f"_rest_{name}")).cast("long"))
        rest = f"_rest_{name}"
    return out.withColumn("_other", F.char_length(rest).cast("long"))


CLASS_COLUMNS = [f"_{name}" for name, _ in CLASSES] + ["_other"]


def _base(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, classes, common, shares): class shares, the common words, and their shares with the rest's last.

    Counts cover every document, and every language has a reference, however small; a null lang is the language "". Words are counted in each task before the
    shuffle, and each task passes on no more than the common words of its share of each language.
    """
    base = _base(docs, text_col, text_col, lang_col)
    classes = _classes(base).groupBy("_lang").agg(*[F.sum(c).alias(c) for c in CLASS_COLUMNS])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in CLASS_COLUMNS])
    classes = classes.select("_lang", F.array(*[F.col(c) / F.greatest(total, F.lit(1)) for c in CLASS_COLUMNS]).alias("classes"))
    each = base.select("_lang", F.explode(words(F.lower("_text"))).alias("_w"))
    each = each.select("_lang", F.when(F.char_length("_w") <= COMMON_LENGTH, F.col("_w")).alias("_w"))
    counts = cut(each.groupBy("_lang", "_w").agg(F.count("*").alias("_k")))
    totals = counts.groupBy("_lang").agg(F.sum("_k").alias("_all"))
    top = counts.where("_w is not null").withColumn("_r", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_k"), "_w"))).where(F.col("_r") <= COMMON_WORDS)
    top = top.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_r", "_w", "_k"))).alias("_top"))
    both = top.join(totals, "_lang").join(classes, "_lang")
    shares = F.transform("_top", lambda x: x["_k"] / F.col("_all"))
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return both.select(F.col("_lang").alias("lang"), "classes", F.transform("_top", lambda x: x["_w"]).alias("common"), F.concat(shares, F.array(rest)).alias("shares"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length, 0 to 1."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def sorted_distance(places: Column, n: Column, shares: Column) -> Column:
    """js_distance of n things from shares, by the runs of a sorted array of places; what has no place in it counts to the last share.

    A share that no place names adds itself to the divergence, so only those named are looked at.
    """

    def term(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q)) - q).otherwise(0.0)).otherwise(0.0)

    def total(starts):
        of = F.transform(starts, lambda at, i: term((F.coalesce(F.get(starts, i + 1), F.size(places)) - at) / n, F.get(shares, F.get(places, at) - 1)))
        return F.aggregate(of, 1 + term((n - F.size(places)) / n, F.element_at(shares, -1)), lambda a, x: a + x)

    starts = F.array_compact(F.transform(places, lambda v, i: F.when(F.coalesce(F.get(places, i - 1) != v, F.lit(True)), i)))
    return F.sqrt(F.greatest(F.lit(0.0), let(starts, total) / 2))


def repeated_words(word_list: Column, k: int = WINDOW_WORDS) -> Column:
    """Words covered by windows of k words that the array holds twice or more, first ones included.

    Windows are compared by 64-bit hashes of their words' hashes. Arrays without a repeated window, nearly all,
    are settled by counting distinct hashes; the others are sorted, which is n log n for any text.
    """

    def covered(places):
        gaps = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(k), F.get(places, i + 1) - p), F.lit(k)).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(ordered):
        again = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def from_windows(hashes):
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, repeats))

    def hashed(h, size=1):
        # hashes of runs of twice as many, from two that stand side by side; the last ones reach k words by overlapping
        if size == k:
            return from_windows(F.slice(h, F.lit(1), F.size(word_list) - (k - 1)))
        step = min(size, k - size)
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), lambda x: hashed(x, size + step))

    return F.when(F.size(word_list) < k, F.lit(0).cast("long")).otherwise(let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda h: hashed(h)))


def quality_rules(docs: DataFrame, references: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_columns: bool = False) -> DataFrame:
    """Judges every document: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_classes, js_words).

    base_failed: under 20 words, or over 30 % of words in repeated 8-word windows. kept: not base_failed, and
    neither histogram further from its language's than allowed. Null or empty texts have zeros and fail; a null
    lang counts as a language of its own; below the minimum lengths a distance is null
    and speaks for the document. Repeated rows give repeated rows, an empty table an empty result; texts have any length, and of
    common words with equal counts the first in order is taken. Columns of docs may have any names. keep_columns: all columns of docs as one struct ``_row``
    instead of the counts, with kept as ``_kept``. Each row is judged where it is read: only references are broadcast, after a
    check of their number, and more of them are joined by a shuffle.
    """
    refs = cut(references if references is not None else language_references(docs, text_col, lang_col)).select(F.col("lang").alias("_lang"), F.col("classes").alias("_ref_classes"), F.col("common").alias("_ref_common"), F.col("shares").alias("_ref_shares"))
    few = refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    base = _base(docs, id_col, text_col, lang_col)
    if keep_columns:
        base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.lit(0).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"))
    base = base.join(F.broadcast(refs) if few else refs, "_lang", "left")
    out = _classes(base).withColumn("_words", words(F.col("_text"))).withColumn("_n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    places = F.transform("_words", lambda w: F.when(F.char_length(w) <= COMMON_LENGTH, F.coalesce(F.array_position(F.col("_ref_common"), F.lower(w)).cast("int"), F.lit(0))).otherwise(F.lit(0)))

    def histogram(found):
        return let(F.sort_array(F.filter(found, lambda p: p > 0)), lambda x: sorted_distance(x, F.col("_n_words"), F.col("_ref_shares")))

    js_classes = F.when((F.col("_n") >= MIN_CLASS_CHARS) & F.col("_ref_classes").isNotNull(), js_distance(F.array(*[F.col(c) / F.col("_n") for c in CLASS_COLUMNS]), F.col("_ref_classes")))
    js_words = F.when((F.col("_n_words") >= MIN_HISTOGRAM_WORDS) & F.col("_ref_common").isNotNull(), let(places, histogram))
    out = out.withColumns({
        "word_chars": F.col("_n").cast("long") - F.col("_space"),
        "n_symbols": F.col("_symbol"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "js_classes": js_classes,
        "js_words": js_words,
    })
    out = out.withColumn("base_failed", (F.col("_n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("js_classes") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("js_words") <= MAX_WORD_DISTANCE, F.lit(True))
    if keep_columns:
        # written once: moved into a filter, the parts that verdicts share would be computed for each use
        return store(out.select("_row", kept.alias("_kept")))
    return out.select(F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "js_classes", "js_words")
