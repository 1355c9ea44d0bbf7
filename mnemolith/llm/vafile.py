"""Operator 9: exact top-k inner products by a vector-approximation file.

Vectors are written in blocks of bounded size: their quantised cells in one column, the exact vectors in another. Blocks of
queries scan the cells alone, group by group of blocks, for bounds of all scores, and keep what may be among the best k. Exact vectors
are then read by id in order of the bounds: first those of the 2 k highest upper bounds, which settle a k-th score, then those
whose bound reaches it. Queries meet groups by number, so a task holds one group and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, store

SCALE = 64
K = 20
#: Vectors of a block, blocks of a group, blocks of queries that share one copy of a group, and queries scanned at once.
BLOCK, GROUP, SHARE, AT_ONCE = 1024, 16, 16, 128
BITS = 5
#: Integer components and scores end here; larger ones count as the last.
MOST, LAST = 2.0**62, 2**63 - 1


def _pack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and integer vectors of one block; of rows with one id the smallest vector stays."""
    ids = table["vec_id"].to_numpy().astype(np.int64)
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat.reshape(len(ids), -1) * SCALE), -MOST, MOST).astype(np.int64)
    order = np.lexsort((*whole.T[::-1], ids))
    ids, whole = ids[order], whole[order]
    first = np.diff(ids, prepend=ids[0] - 1) != 0
    return ids[first], whole[first]


def _raw(whole: np.ndarray) -> bytes:
    """Integers as their width in bytes and the bytes."""
    most = np.abs(whole).max() if whole.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - 1)
    return bytes([width]) + whole.astype(f"<i{width}").tobytes()


def _whole(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1)


def cells(whole: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Cell numbers of BITS bits a component, packed; the least value and the width of a cell for each dimension."""
    low = whole.min(0).astype(np.float64)
    width = np.ceil((whole.max(0).astype(np.float64) - low + 1) / (1 << BITS))
    codes = np.clip((whole.astype(np.float64) - low) // width, 0, (1 << BITS) - 1).astype(np.uint8)
    return np.packbits((codes.reshape(-1, 1) >> np.arange(BITS, dtype=np.uint8)) & 1).tobytes(), low, width


def middles(packed: bytes, low: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """The middles of the cells of n vectors."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * len(low) * BITS).reshape(-1, BITS)
    codes = (bits << np.arange(BITS, dtype=np.uint8)).sum(1, dtype=np.uint8).reshape(n, len(low))
    return low + codes * width + (width - 1) / 2


def candidates(query_ids: np.ndarray, queries: np.ndarray, blocks: list, k: int):
    """(queries, offsets, vectors, lower, upper) arrays for some queries: the vectors of a group whose upper bound reaches the k-th lower one, query after query.

    blocks: (ids, middles, half widths) of each block of the group.
    """
    ids = np.concatenate([b[0] for b in blocks])
    for at in range(0, len(query_ids), AT_ONCE):
        q, own = queries[at : at + AT_ONCE], query_ids[at : at + AT_ONCE]
        guess = np.concatenate([q @ m.T for _, m, _ in blocks], 1)
        # half a cell for each component, and what rounding may do
        slack = [np.abs(q) @ half + 1e-9 * (1 + np.abs(q) @ np.abs(m).max(0)) for _, m, half in blocks]
        slack = np.concatenate([np.repeat(s[:, None], len(b[0]), 1) for s, b in zip(slack, blocks)], 1)
        other = own[:, None] != ids
        lower = np.where(other, guess - slack, -np.inf)
        floor = np.partition(lower, len(ids) - k, 1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
        row, col = np.nonzero(other & (guess + slack >= floor[:, None]))
        yield own, np.searchsorted(row, np.arange(len(own) + 1)).astype(np.int32), ids[col], lower[row, col], (guess + slack)[row, col]


def _products(a: list[bytes], b: list[bytes]) -> list[int]:
    """Integer inner products of pairs: in doubles where all partial sums fit in 53 bits, else in Python's integers, up to the last of 64 bits."""
    out = np.zeros(len(a), np.int64)
    kinds = np.array([(len(x), x[0], y[0]) for x, y in zip(a, b)], np.int64).reshape(-1, 3)
    for kind in {tuple(x) for x in kinds.tolist()}:
        at = np.flatnonzero((kinds == kind).all(1))
        x, y = (np.frombuffer(b"".join([v[i][1:] for i in at]), f"<i{w}").reshape(len(at), -1) for v, w in ((a, kind[1]), (b, kind[2])))
        if x.size and float(np.abs(x.astype(np.float64)).max()) * float(np.abs(y.astype(np.float64)).max()) * x.shape[1] >= 2.0**53:
            out[at] = [max(-LAST, min(LAST, sum(int(p) * int(q) for p, q in zip(*r)))) for r in zip(x, y)]
        else:
            out[at] = (x.astype(np.float64) * y).sum(1).astype(np.int64)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest scores among all vectors but those of its own id.

    A component x counts as floor(64 x), up to 2^62; the score is the integer inner product, up to the ends of 64 bits; ties go to
    the smaller id. Null vectors and ids, and vectors with null or non-finite components, take no part; neither do pairs of
    different lengths, and vectors without components score 0 with each other. Of rows that repeat an id the smallest vector
    of each length takes part. Fewer than k others give fewer rows; empty tables none. Other columns are left behind.
    """

    def usable(df):
        v = F.col(vector_col).cast("array<double>")
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
        return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("dim", F.size("v"))

    all_, asked = usable(vectors), usable(queries)
    blocks, asks = max(1, -(-all_.count() // BLOCK)), max(1, -(-asked.count() // BLOCK))
    groups, shares = -(-blocks // GROUP), -(-asks // SHARE)

    def pack_block(key, table):
        ids, whole = _pack(table)
        packed, low, width = cells(whole)
        exact = pa.array([_raw(x) for x in whole], pa.binary())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": [ids.tobytes()], "cells": [packed], "low": [low.tobytes()], "width": [width.tobytes()], "exact": pa.ListArray.from_arrays(pa.array([0, len(exact)], pa.int32()), exact)})

    def pack_queries(key, table):
        ids, whole = _pack(table)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "ask": pa.array([key[1].as_py()], pa.int32()), "ids": [ids.tobytes()], "query": [_raw(whole)]})

    def deal(df, n, name):
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(n)).cast("int")).groupBy("dim", name)

    file = store(deal(all_, blocks, "block").applyInArrow(pack_block, "dim int, block int, ids binary, cells binary, low binary, width binary, exact array<binary>"))
    wanted = cut(deal(asked, asks, "ask").applyInArrow(pack_queries, "dim int, ask int, ids binary, query binary"))
    none = F.lit(None).cast("binary")
    cells_ = file.select("dim", (F.col("block") % groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(-1).alias("ask"), "ids", "cells", "low", "width", none.alias("query"))
    asks_ = wanted.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), (F.col("ask") % shares).alias("share"), "ask", "ids", none.alias("cells"), none.alias("low"), none.alias("width"), "query")
    meet = cells_.unionByName(asks_).repartition(groups * shares, "dim", "group", "share").sortWithinPartitions("dim", "group", "share", "ask")

    def scan(batches):
        now, group = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                if (key := (x["dim"], x["group"], x["share"])) != now:
                    now, group = key, []
                ids = np.frombuffer(x["ids"], np.int64)
                if x["ask"] < 0:
                    low, width = np.frombuffer(x["low"]), np.frombuffer(x["width"])
                    group.append((ids, middles(x["cells"], low, width, len(ids)), (width - 1) / 2))
                elif group:
                    for found in candidates(ids, _whole(x["query"]).reshape(len(ids), -1).astype(np.float64), group, k):
                        own, offsets, *lists = found
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), now[0]), pa.int32()), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]], names=["query_id", "dim", "vec_ids", "lower", "upper"])

    # one row for a query and group
    maybe = store(meet.mapInArrow(scan, "query_id bigint, dim int, vec_ids array<bigint>, lower array<double>, upper array<double>"))
    own = Window.partitionBy("query_id", "dim")
    lower = maybe.select("query_id", "dim", F.explode(F.slice(F.sort_array("lower", asc=False), 1, k)).alias("lower"))
    floor = lower.withColumn("n", F.row_number().over(own.orderBy(F.desc("lower")))).where(F.col("n") == k).select("query_id", "dim", F.col("lower").alias("floor"))
    both = F.arrays_zip("vec_ids", "upper")
    near = maybe.join(floor, ["query_id", "dim"], "left").select("query_id", "dim", F.explode(F.filter(both, lambda x: F.col("floor").isNull() | (x["upper"] >= F.col("floor")))).alias("_x"))
    near = near.select("query_id", "dim", F.col("_x.vec_ids").alias("vec_id"), "_x.upper").withColumn("turn", F.row_number().over(own.orderBy(F.desc("upper"), "vec_id")))
    near = store(near.select("query_id", "vec_id", "upper", "dim", "turn"))

    def each(batches):
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            dims = np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(np.concatenate(ids)), batch.column(2).flatten()], names=["dim", "vec_id", "exact"])

    exact = file.select("dim", "ids", "exact").mapInArrow(each, "dim int, vec_id bigint, exact binary")

    def split(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                whole = _whole(batch.column(2)[row].as_py()).reshape(len(ids), -1)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(ids), pa.int32()), pa.array(ids), pa.array([_raw(x) for x in whole], pa.binary())], names=["dim", "query_id", "query"])

    asked_ = wanted.select("dim", "ids", "query").mapInArrow(split, "dim int, query_id bigint, query binary")

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(_products(batch.column(3).to_pylist(), batch.column(4).to_pylist()), pa.int64())], names=["query_id", "vec_id", "dim", "score"])

    def scored(pairs):
        both = pairs.select("query_id", "vec_id", "dim").join(exact, ["vec_id", "dim"]).join(asked_, ["query_id", "dim"])
        return both.select("query_id", "vec_id", "dim", "query", "exact").mapInArrow(score, "query_id bigint, vec_id bigint, dim int, score bigint")

    first = cut(scored(near.where(F.col("turn") <= 2 * k)))
    # nothing below the k-th score of those read first can be among the best
    least = first.withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") == k).select("query_id", "dim", F.col("score").alias("least"))
    rest = near.where(F.col("turn") > 2 * k).join(least, ["query_id", "dim"]).where(F.col("upper") >= F.col("least"))
    found = first.unionByName(scored(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
