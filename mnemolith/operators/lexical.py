"""Lexical search: postings, corpus statistics and BM25 for many queries at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemolith.functions import text as fx
from mnemolith.sources.tables import no_shuffle_files_left

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Terms of a batch of queries up to this number are broadcast to the postings.
BROADCAST_TERMS = 100_000


def postings(docs: DataFrame, keys: list[str], text_col: str = "text", analyse=fx.terms) -> DataFrame:
    """(keys, doc_len, term, tf), one row for each term of a document."""
    each = docs.select(*keys, analyse(text_col).alias("_t")).select(*keys, F.size("_t").cast("long").alias("doc_len"), F.explode("_t").alias("term"))
    return each.groupBy(*keys, "doc_len", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, keys: list[str], text_col: str = "text", analyse=fx.terms) -> DataFrame:
    """(term, df, tf) over a corpus."""
    return postings(docs, keys, text_col, analyse).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text", analyse=fx.terms) -> DataFrame:
    """(n_docs, n_terms, avgdl)."""
    return docs.select(F.size(analyse(text_col)).cast("long").alias("n")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avgdl"))


def asked_terms(queries: DataFrame, query_col: str = "query", analyse=fx.terms) -> DataFrame:
    """(query_id, term) of a batch of queries, each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(analyse(query_col))).alias("term"))


def scored(counts: DataFrame, n_docs, avgdl, asked: DataFrame, keys: list[str], hint=lambda x: x) -> DataFrame:
    """(query_id, keys, score) from the postings (keys, doc_len, term, tf) of asked terms in a corpus of n_docs documents of mean length avgdl. hint: what is done to tables of asked terms before they are joined."""
    df = counts.groupBy("term").agg(F.count("tf").alias("df"))  # by a column that the scores need too, so that one shuffle serves both
    idf = F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / avgdl))
    rows = counts.join(hint(df), "term").withColumn("_part", part).join(hint(asked), "term")
    return rows.groupBy("query_id", *keys).agg(F.round(F.sum("_part"), 6).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, keys: list[str], k: int | None = 10, text_col: str = "text", query_col: str = "query", analyse=fx.terms) -> DataFrame:
    """(query_id, keys, score, rank) of the documents that hold a term of a query, best first, ties by key.

    The plain way over a corpus without an index: only postings of query terms are counted; the corpus statistics are one scalar subquery.
    """
    asked = asked_terms(queries, query_col, analyse)
    each = docs.select(*keys, analyse(text_col).alias("_t")).select(*keys, F.size("_t").cast("long").alias("doc_len"), F.explode("_t").alias("term"))
    tf = each.join(asked.select("term").distinct(), "term", "left_semi").groupBy(*keys, "doc_len", "term").agg(F.count("*").alias("tf"))
    stats = corpus_stats(docs, text_col, analyse).select(F.struct("n_docs", "avgdl")).scalar()
    return ranked(scored(tf.withColumn("_s", stats), F.col("_s.n_docs"), F.col("_s.avgdl"), asked, keys), ["query_id"], keys, k)


class Index:
    """A stored inverted index: segments of postings, dealt to folders by term, and corpus statistics.

    Each task inverts the documents that it reads, so what is shuffled and written is one row for a term of a segment. A search reads the folders of its
    terms only, and the lists of the segments' keys.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, keys: list[str], path: str, text_col: str = "text", analyse=fx.terms, stem: bool = False) -> Index:
        """Tokenises a corpus once and writes its segments, by Porter stems if asked for; statistics are counted from what is written."""
        texts = docs.select(F.struct(*keys).alias("version"), analyse(text_col).alias("terms"))
        with no_shuffle_files_left(docs.sparkSession):
            dealt(segments(texts, distinct=False, stem=stem)).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        kind = texts.schema["version"].dataType.simpleString()
        lens = docs.sparkSession.read.schema(f"{segment_schema(kind)}, bucket int").parquet(f"{path}/postings").where(F.col("bucket") == LISTS).select(F.explode(F.col("lens").cast("array<long>")).alias("n"))
        # an empty document has no posting, but counts
        lens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avgdl"), F.lit(stem).alias("stem"), F.lit(kind).alias("kind")).coalesce(1).write.parquet(f"{path}/stats")
        return cls(docs.sparkSession, path)

    def search(self, queries: DataFrame, keys: list[str], k: int | None = 10, query_col: str = "query", analyse=fx.terms) -> DataFrame:
        """What bm25 gives over the indexed corpus; the batch of queries is taken to be small, which is checked before it is broadcast."""
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        asked = asked_terms(queries, query_col, analyse)
        if stats.stem:
            asked = asked.join(stems(asked), "term").select("query_id", F.col("stem").alias("term")).distinct()
        small = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        hint = F.broadcast if small else lambda x: x
        words = asked.select("term").distinct().withColumn("bucket", folder())
        folders = [r.bucket for r in words.select("bucket").distinct().collect()]
        log = self.spark.read.schema(f"{segment_schema(stats.kind)}, bucket int").parquet(f"{self.path}/postings")
        held = log.where(F.col("bucket").isin(folders)).join(hint(words), ["bucket", "term"]).select("segment", "term", "places", "tfs")
        lists = log.where(F.col("bucket") == LISTS).select("segment", "versions", "lens")
        each = F.transform(F.arrays_zip("places", "tfs"), lambda x: F.struct(F.get("versions", x["places"]).alias("_k"), F.get("lens", x["places"]).cast("long").alias("doc_len"), x["tfs"].cast("long").alias("tf")))
        rows = held.join(lists, "segment").select("term", F.explode(each).alias("_p")).select(*[F.col(f"_p._k.{c}").alias(c) for c in keys], "_p.doc_len", "term", "_p.tf")
        # a key may stand for several documents, so its counts are put together; all that follows goes by keys as well
        counts = rows.repartition(*keys).groupBy(*keys, "doc_len", "term").agg(F.sum("tf").alias("tf"))
        return ranked(scored(counts, F.lit(stats.n_docs), F.lit(stats.avgdl), asked, keys, hint), ["query_id"], keys, k)


def ranked(scores: DataFrame, group: list[str], keys: list[str], k: int | None, score: str = "score") -> DataFrame:
    """Adds the rank by score within a group, ties by key, and keeps the best k."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), *keys)).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def term_counts(docs: DataFrame, queries: DataFrame, keys: list[str], k: int | None = 10, text_col: str = "text", query_col: str = "query") -> DataFrame:
    """The plain way without an index: scores are how often the words of a query stand in a text, anywhere."""
    asked = queries.select("query_id", fx.query_words(query_col).alias("_q")).where(F.size("_q") > 0)
    batch = asked.agg(F.array_sort(F.collect_list(F.struct("query_id", "_q"))).alias("b")).scalar()  # a stated batch of queries, as one value in the plan
    kept = F.filter("_batch", lambda x: F.size(x["_q"]) > 0)

    def scores(low):
        times = lambda w: F.floor((F.char_length(low) - F.char_length(F.replace(low, w, F.lit("")))) / F.char_length(w)).cast("long")
        return F.transform(kept, lambda x: F.struct(x["query_id"].alias("query_id"), F.aggregate(x["_q"], F.lit(0).cast("long"), lambda a, w: a + times(w)).alias("score")))

    # the text is lower-cased once and looked at in its row; only scores go on
    found = F.transform(F.array(F.lower(F.coalesce(text_col, F.lit("")))), scores)[0]
    each = docs.withColumn("_batch", batch).select(*keys, F.explode(F.filter(found, lambda x: x["score"] > 0)).alias("_x"))
    return ranked(each.select("_x.query_id", *keys, "_x.score"), ["query_id"], keys, k)


#: A segment of an index closes at so many texts or words.
SEGMENT_TEXTS, SEGMENT_WORDS = 1 << 14, 4_000_000
#: The folder of an index that lists the texts of its segments, and how many tasks write another folder.
LISTS, TASKS = -1, 4
_INTS = pa.list_(pa.int32())


def segment_schema(kind: str = "string") -> str:
    """Columns of segments whose versions are of a kind."""
    return f"segment string, term string, places array<int>, tfs array<int>, versions array<{kind}>, lens array<int>"


SEGMENT = segment_schema()


def segment(versions: pa.Array, terms: pa.Array, name: str | None = None, stem: bool = False):
    """The rows of one segment as Arrow batches. Without a name equal versions are taken once, and the hash of the versions is its name, so equal names hold equal rows."""
    if name is None:
        first = {}
        for i, v in enumerate(versions.to_pylist()):
            first.setdefault(v, i)
        if len(first) < len(versions):
            terms, versions = terms.take(pa.array(first.values())), pa.array(first)
        name = hashlib.sha256("".join(first).encode()).hexdigest()[:32]
    n, lens, lists_of = len(versions), terms.value_lengths().to_numpy(), pa.list_(versions.type)
    schema = pa.schema([("segment", pa.string()), ("term", pa.string()), ("places", _INTS), ("tfs", _INTS), ("versions", lists_of), ("lens", _INTS)])
    none = lambda k: pa.nulls(k)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
    whole = [pa.array([name]), none(1).cast(pa.string()), none(1).cast(_INTS), none(1).cast(_INTS), one(versions), one(pa.array(lens, pa.int32()))]
    yield pa.RecordBatch.from_arrays(whole, schema=schema)
    words = terms.flatten().dictionary_encode()
    if not len(words):
        return
    if stem:
        by_stem = pa.array(map(porter, words.dictionary.to_pylist())).dictionary_encode()
        words = pa.DictionaryArray.from_arrays(by_stem.indices.take(words.indices), by_stem.dictionary)
    k = len(words.dictionary)
    pairs, tfs = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
    at = pa.array(np.searchsorted(pairs, np.arange(k + 1, dtype=np.int64) * n), pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (pairs % n, tfs)]
    rows = pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(k, np.int32))), words.dictionary, *lists, pa.nulls(k, lists_of), none(k).cast(_INTS)], schema=schema)
    for i in range(0, k, 20_000):
        yield rows.slice(i, 20_000)


def segments(texts: DataFrame, distinct: bool = True, stem: bool = False) -> DataFrame:
    """Inverted segments of texts (version, terms): for each term its texts, by their places in the segment, and its counts in them; and a row without a term that lists the texts and their lengths.

    Each task inverts what it reads, so no posting is shuffled on its own. Equal versions are taken once within a segment, or else (distinct=False) each
    row is a text of its own; stem: terms are put together by Porter stem.
    """
    schema = segment_schema(texts.schema["version"].dataType.simpleString())
    kind = to_arrow_schema(T._parse_datatype_string(schema)).field("versions").type.value_type

    def run(batches):
        held, n, words, closed = [], 0, 0, 0

        def close():
            nonlocal held, n, words, closed
            rows = segment(*map(pa.concat_arrays, zip(*held)), None if distinct else f"{TaskContext.get().partitionId()}-{closed}", stem)
            held, n, words, closed = [], 0, 0, closed + 1
            return rows

        for batch in batches:
            versions, terms = batch.column(0).cast(kind), batch.column(1)
            ends = np.cumsum(terms.value_lengths().to_numpy())
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = min(start + SEGMENT_TEXTS - n, max(start + 1, int(np.searchsorted(ends, before + SEGMENT_WORDS - words, "right"))))
                held.append((versions.slice(start, stop - start), terms.slice(start, stop - start)))
                n, words, start = n + stop - start, words + int(ends[stop - 1] - before), stop
                if n >= SEGMENT_TEXTS or start < len(ends) or words >= SEGMENT_WORDS:
                    yield from close()
        if held:
            yield from close()

    return texts.select("version", "terms").mapInArrow(run, schema)


def folder():
    """The folder of a term, -1 that of lists."""
    return F.when(F.col("term").isNull(), F.lit(LISTS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(Index.BUCKETS)).cast("int"))


def dealt(rows: DataFrame) -> DataFrame:
    """Segments with their folder (bucket), in order of terms. The rows of a term are one for each segment; they go to some tasks, so that a term that most texts hold isn't one task's."""
    return rows.withColumn("bucket", folder()).repartition("bucket", F.pmod(F.xxhash64("term", "segment"), F.lit(TASKS))).sortWithinPartitions("bucket", "term")


def porter(word: str) -> str:
    """The stem of a lower-case word by Porter's algorithm of 1980."""
    if len(word) <= 2:
        return word

    def consonant(i):
        c = word_[i]
        return not (c in "aeiou" or (c == "y" and i > 0 and consonant(i - 1)))

    def forms(w):
        nonlocal word_
        word_ = w
        return "".join("c" if consonant(i) else "v" for i in range(len(w)))

    def measure(w):
        f = forms(w)
        return sum(1 for a, b in zip(f, f[1:]) if a + b == "vc")

    def vowel(w):
        return "v" in forms(w)

    def short(w):
        f = forms(w)
        return f.endswith("cvc") and w[-1] not in "wxy"

    def twice(w):
        return len(w) > 1 and w[-1] == w[-2] and forms(w)[-1] == "c"

    word_, w = word, word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif twice(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
            if w.endswith(end):
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # fixed values: the suffixes of the algorithm's steps
    for step, least in (
        ({"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}, 0),
        ({"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}, 0),
        (dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), ""), 1),
    ):
        for end in sorted(step, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: -len(end)]
                if measure(stem) > least and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem + step[end]
                break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short(w[:-1])):
            w = w[:-1]
    if measure(w) > 1 and twice(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stems(vocabulary: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms of a vocabulary; each is stemmed once, in Arrow batches."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"term": pdf["term"], "stem": pdf["term"].map(porter)})

    return vocabulary.select("term").distinct().mapInPandas(run, "term string, stem string")
