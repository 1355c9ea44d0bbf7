"""Exact cosine search of a batch of query vectors, and the embedding cache."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolith.functions import text as fx

from .lexical import ranked

#: Query vectors that one pass over the vectors takes along; more are taken in several passes.
BLOCK = 2_000


def cosine_scan(vectors: DataFrame, queries: DataFrame, pick, schema: str, id_col: str, vector_col: str, positive: bool) -> DataFrame:
    """What pick(query_id, ids, scores) makes of the matches of each query in each batch of vectors: a record batch of schema.

    Each block of queries is broadcast, its size bounded by BLOCK. Vectors of other lengths, and null or zero ones, don't match.
    """
    asked = queries.select("query_id", F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0").orderBy("query_id")
    block, out = [], None
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")

    def scan(part):
        nonlocal out
        by_size: dict[int, list] = {}
        for r in part:
            by_size.setdefault(len(r.v), []).append(r)
        packed = {n: (np.array([r.query_id for r in rs]), np.array([r.v for r in rs])) for n, rs in by_size.items()}
        shared = vectors.sparkSession.sparkContext.broadcast(packed)

        def run(batches):
            for batch in batches:
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                ids, flat = batch.column(0).to_numpy(), lists.flatten().to_numpy()
                begin = np.cumsum(sizes) - sizes
                for n, (query_ids, q) in shared.value.items():
                    at = np.flatnonzero(sizes == n)
                    if not len(at):
                        continue
                    v = flat[begin[at][:, None] + np.arange(n)]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = np.round((q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)), 6)
                    s[~np.isfinite(s)] = -2
                    if positive:
                        s[s <= 0] = -2
                    for i, query_id in enumerate(query_ids):
                        good = np.flatnonzero(s[i] > -2)
                        if len(good):
                            yield pick(query_id, ids[at][good], s[i][good])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            scan(block)
            block = []
    if block or out is None:
        scan(block)
    return out


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", positive: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the k vectors most like each query vector, of those with a score over 0.

    A task keeps its best k of a batch for each query. Vectors match as in cosine_scan.
    """

    def best(query_id, ids, scores):
        at = np.lexsort((ids, -scores))[:k]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), query_id)), pa.array(ids[at]), pa.array(scores[at])], names=["query_id", "id", "score"])

    out = cosine_scan(vectors, queries, best, "query_id bigint, id bigint, score double", id_col, vector_col, positive)
    return ranked(out, ["query_id"], ["id"], k).withColumnRenamed("id", id_col)


def cosine_hits(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, hits, least): how many vectors have a score over 0, and the least of these scores; counted in the scan, nothing is ranked."""

    def count(query_id, ids, scores):
        return pa.RecordBatch.from_arrays([pa.array([query_id]), pa.array([len(ids)], pa.int64()), pa.array([scores.min()])], names=["query_id", "hits", "least"])

    out = cosine_scan(vectors, queries, count, "query_id bigint, hits bigint, least double", id_col, vector_col, True)
    return out.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.min("least").alias("least"))




def encode_missing(items: DataFrame, cache: DataFrame, encode, model: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(new cache rows, counts): items whose (model, content hash) the cache lacks are encoded once per content, in Arrow batches.

    encode takes a list of texts and returns a 2-d array. counts: requested, cached, encoded.
    """
    wanted = items.select(F.lit(model).alias("model"), F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])
    missing = wanted.join(cache.select("model", "content_hash"), ["model", "content_hash"], "left_anti")

    def run(batches):
        for batch in batches:
            out = np.asarray(encode(batch.column("content").to_pylist()), np.float32).reshape(batch.num_rows, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("content_hash"), pa.array(out.tolist(), pa.list_(pa.float32()))], names=["model", "content_hash", "embedding"])

    new = missing.select("model", "content_hash", "content").mapInArrow(run, "model string, content_hash string, embedding array<float>")
    total = wanted.agg(F.count("*").alias("requested"))
    counts = total.select("requested", missing.agg(F.count("*")).scalar().alias("encoded")).select("requested", "encoded", (F.col("requested") - F.col("encoded")).alias("cached"))
    return new, counts


def term_cell(term, dimensions: int):
    """The component that a term counts in: the first digits of its hash."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 6), 16, 10).cast("long") % dimensions).cast("int")


def hashed_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 64) -> DataFrame:
    """(id, embedding): counts of a text's terms by hashed component, scaled to length 1, as hashed_encoder gives them; null where there is no term."""
    cells = docs.select(F.col(id_col), F.explode(fx.terms(text_col)).alias("_t")).groupBy(id_col, term_cell(F.col("_t"), dimensions).alias("_c")).agg(F.count("*").alias("_n"))
    rows = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias("_m"), F.sqrt(F.sum(F.col("_n") * F.col("_n")).cast("double")).alias("_l"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) / F.col("_l"))
    return docs.select(id_col).join(rows.select(id_col, vector.alias("embedding")), id_col, "left")


def hashed_encoder(dimensions: int = 64):
    """An embedder that needs no model: counts of hashed words, scaled to length 1."""
    import hashlib
    import re
    import unicodedata

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts):
            plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
            for word in re.findall(r"[^\W_]+", plain):
                row[int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dimensions] += 1
            row /= np.linalg.norm(row) or 1
        return out

    return encode
