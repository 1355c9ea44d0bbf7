"""How common hashed items are over a whole corpus, by counters of fixed number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cleaning

#: log2 of the number of counters, the parts they are added in, and the salts of their first sums.
BITS, PARTS, SALTS = 20, 64, 1024


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def levels(texts: DataFrame, hashes) -> np.ndarray:
    """For each counter the log2 of its items, at most 31; hashes(list of bytes) yields arrays of 64-bit hashes for the one column of texts.

    Each task sends one set of counters; they are added in two steps, in groups of bounded size.
    """
    size = (1 << BITS) // PARTS

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for at, to in slices(batch.column(0)):
                for h in hashes(batch.column(0).slice(at, to - at).to_pylist()):
                    total += np.bincount(bucket(h), minlength=1 << BITS)
        parts = total.reshape(PARTS, size)
        at = [i for i in range(PARTS) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.minimum(parts[i], 2**31 - 1).astype(np.int32).tobytes() for i in at], pa.binary())], names=["part", "n"])

    def add(key, table):
        total = np.zeros(size, np.int64)
        for x in table["n"]:
            total += np.frombuffer(x.as_py(), np.int32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    each = texts.mapInArrow(count, "part int, n binary").withColumn("salt", F.spark_partition_id() % SALTS)
    some = each.groupBy("part", "salt").applyInArrow(add, "part int, n binary")
    out = np.zeros((PARTS, size), np.int32)
    with cleaning(texts.sparkSession):
        for r in some.groupBy("part").applyInArrow(add, "part int, n binary").collect():
            out[r.part] = np.frombuffer(r.n, np.int32)
    return np.log2(out.ravel() + 1.0).astype(np.uint8)
