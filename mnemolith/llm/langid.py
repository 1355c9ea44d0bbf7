"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

The log-probability matrix, buckets by languages, is broadcast in parts of bounded size; a batch of texts becomes a sparse matrix
of counts, texts by buckets, and its product with the log-probability matrix is summed in numpy.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: The model is fitted on about so many rows of each language, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 5_000
#: Languages of one broadcast, which bounds it to 32 MB; more languages are scored one part after another.
PART = 64
#: Code points that are looked at together, and bytes of matrix rows gathered at once.
PIECE, GATHERED = 1_000_000, 32_000_000
#: Labels up to this number are broadcast with their counts; more of them meet the rows in a join.
BROADCAST_LABELS = 100_000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case form, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(x) if len(x := s.lower()) == 1 else c
    return out


def _letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, with one break after each run of them, and the text that each belongs to."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    low = letters()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = low > 0
    keep[1:] |= keep[:-1].copy()
    of = np.repeat(np.arange(len(texts)), lens)[keep]
    low = low[keep]
    low[low == 0] = 32
    return low, of


def _runs(texts: list[str]):
    """(letters, text of each, letters at the start that were seen before): some texts at a time, a long one in pieces.

    A piece begins with the last letters of the one before, so that each n-gram ends in exactly one piece, and a
    break between pieces stands once, as in the whole text.
    """
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and chars + len(texts[to]) <= PIECE:
            chars += len(texts[to])
            to += 1
        if to > at:
            low, of = _letters_of(texts[at:to])
            yield low, of + at, 0
            at = to
            continue
        text, carry = texts[at], np.zeros(0, np.uint32)
        for byte in range(0, len(text), PIECE):
            piece = text[byte : byte + PIECE]
            low, _ = _letters_of([piece])
            if byte + PIECE < len(text) and letters()[ord(piece[-1])] and letters()[ord(text[byte + PIECE])]:
                low = low[:-1]  # the run of letters goes on
            whole = np.concatenate([carry, low])
            yield whole, np.full(len(whole), at), len(carry)
            carry = whole[max(0, len(whole) - max(ORDERS) + 1) :]
        at += 1


def grams(texts: list[str]):
    """(buckets, text of each): all n-grams of some texts, in parts."""
    for low, of, seen in _runs(texts):
        with np.errstate(over="ignore"):
            h = np.full(len(low), 2166136261, np.uint32)
            for n in range(1, max(ORDERS) + 1):
                m = len(low) - n + 1
                if m <= 0:
                    break
                h = (h[:m] ^ low[n - 1 :]) * np.uint32(16777619)
                h ^= h >> np.uint32(13)
                if n in ORDERS:
                    whole = of[:m] == of[n - 1 :]
                    whole[: max(0, seen - n + 1)] = False
                    yield ((h * np.uint32(2654435761)) >> np.uint32(16))[whole], of[:m][whole]


def features(texts: list[str]) -> np.ndarray:
    """Counts of all buckets over a list of texts."""
    out = np.zeros(BUCKETS, np.int64)
    for buckets, _ in grams(texts):
        out += np.bincount(buckets, minlength=BUCKETS)
    return out


def sparse_counts(texts: list[str]):
    """(texts, buckets, counts) of the non-zero cells of some texts' count matrix, in order of text; a long text may come in parts."""
    for buckets, of in grams(texts):
        cells, n = np.unique(of * BUCKETS + buckets, return_counts=True)
        yield cells // BUCKETS, cells % BUCKETS, n


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Languages in order, log probabilities in broadcasts of PART languages each, and the log of each language's share."""

    def __init__(self, names: list[str], parts: list, prior: np.ndarray) -> None:
        self.names, self.parts, self.prior = names, parts, prior


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all languages that rows have; rows without a label or id teach nothing.

    Shares count all rows, n-grams about ROWS_PER_LANGUAGE rows of each language. Counts of one language become one dense row
    of 512 kB on the executors; PART of them at a time come to the driver and go out as one broadcast.
    """
    sc = labelled.sparkSession.sparkContext
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    each = cut(rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("rows")))
    share = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    few = each.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    share = share.join(F.broadcast(each) if few else each, "lang")
    taken = share.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) <= 1e6 * ROWS_PER_LANGUAGE / F.col("rows"))

    def count(batches):
        seen: dict[str, np.ndarray] = {}

        def told():
            for lang, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
            seen.clear()

        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for at, to in slices(texts):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[at:to], texts.slice(at, to - at).to_pylist()):
                    by.setdefault(lang, []).append(text or "")
                for lang, own in by.items():
                    seen[lang] = seen.get(lang, 0) + features(own)
                    if len(seen) >= PART:
                        yield from told()
        yield from told()

    def dense(key, table):
        n = np.zeros(BUCKETS)
        n[table["bucket"].to_numpy()] = table["n"].to_numpy()
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "n": pa.array([n.tobytes()], pa.binary())})

    counts = taken.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = cut(counts.groupBy("lang").applyInArrow(dense, "lang string, n binary"))
    shares = {r.lang: r.rows for r in each.collect()}
    names, parts = sorted(shares), []
    for at in range(0, len(names), PART):
        own = names[at : at + PART]
        got = {r.lang: np.frombuffer(r.n) for r in counts.where((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])).collect()}
        table = np.stack([got.get(x, np.zeros(BUCKETS)) for x in own]) + SMOOTHING
        parts.append(sc.broadcast(np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T)))
    prior = np.array([shares[x] for x in names], float)
    return Model(names, parts, np.log(prior / prior.sum()) if names else prior)


def scores(texts: list[str], cells: list, by_bucket: np.ndarray) -> np.ndarray:
    """The product of the texts' count matrix, as sparse_counts gives it, and a matrix of buckets by languages."""
    total = np.zeros((len(texts), by_bucket.shape[1]))
    step = max(1, GATHERED // (8 * by_bucket.shape[1]))
    for of, buckets, n in cells:
        for at in range(0, len(of), step):
            own = of[at : at + step]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[starts]] += np.add.reduceat(by_bucket[buckets[at : at + step]] * n[at : at + step, None], starts)
    return total


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the most probable language and its posterior probability.

    ``und`` with score 0 for a null text, one without letters, or an empty model; ties go to the first language in order. Texts
    of any length are read whole: pieces of one text meet without a gap. Only the text is looked at, whatever other
    columns there are; rows are independent, so repeated rows and ids give repeated rows, and an empty table an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names, parts, prior = model.names, model.parts, model.prior

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, to in slices(texts, 1_000_000):
                part = [x or "" for x in texts.slice(at, to - at).to_pylist()]
                langs, posterior = [UNDETERMINED] * len(part), np.zeros(len(part))
                if names:
                    cells = list(sparse_counts(part))
                    some = np.zeros(len(part), bool)
                    for of, _, _ in cells:
                        some[of] = True
                    total = np.empty((len(part), len(names)))
                    for i, shared in enumerate(parts):
                        own = slice(i * PART, i * PART + shared.value.shape[1])
                        total[:, own] = scores(part, cells, shared.value) + prior[own]
                        if len(parts) > 1:
                            del shared._value  # read again for the next slice: one part is held at a time
                    best = total.argmax(1)
                    posterior = np.where(some, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
                    langs = [names[b] if x else UNDETERMINED for b, x in zip(best, some)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(langs, pa.string()), pa.array(posterior, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
