"""Operator 7: substring dedup by super-k-mers.

A window is k consecutive words; its minimiser is the rarest m-gram in it, by a counting sketch of the whole corpus, then
the one of least hash, then the leftmost. Consecutive windows with the same minimiser occurrence form a super-k-mer.
Equal windows have equal minimisers, and a common phrase is only chosen where all of its surroundings are as common, so
buckets stay small. Of equal super-k-mers all but the earliest repeat it whole, which 128 bits of hash tell without
their text. Only the earliest of those that share a minimiser with different ones travel, as one packed string
each, to the bucket of their minimiser, where sorting brings equal windows together word by word. A minimiser that many
strings share is taken apart further, by window, so that no bucket grows with the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, release, store
from .sketch import bucket, levels

K, M = 20, 6
#: Bytes of text looked at together, and super-k-mers held until those that repeat among them are told apart.
PIECE, HELD = 1 << 20, 500_000
#: A minimiser that more strings share is no bucket of its own: its windows are dealt out one by one.
HOT = 4_096
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NEXT_SPACE = re.compile(rb"[\t-\r ]").search
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Places of grams in a piece: one of PIECE bytes and a last word has fewer.
PLACE = np.uint64((1 << 20) - 1)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n of each at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((ODD, INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in a run of UTF-8 bytes that ends in white space, and a 64-bit hash of its bytes.

    Bytes are summed in blocks, whatever the length of the run; the parts of a word that spans blocks are added up.
    """
    edge = np.flatnonzero(np.diff(SPACE[raw], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(starts), np.uint64)
    power, inverse = powers(min(PIECE, len(raw)) + 1)
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part))
        if first == last:
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * power[: len(part)], out=sums[1:])
        begin, end = np.maximum(starts[first:last] - at, 0), np.minimum(ends[first:last] - at, len(part))
        own = (sums[end] - sums[begin]) * inverse[begin]
        if starts[first] < at:
            own[:1] *= np.uint64(pow(int(ODD), int(at - starts[first]), 1 << 64))
        total[first:last] += own
    return starts, mix(total + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, m: int) -> np.ndarray:
    grams = hashes[: max(0, len(hashes) - m + 1)].copy()
    for j in range(1, m):
        grams = grams * ODD + hashes[j : len(hashes) - m + 1 + j]
    return mix(grams)


def super_kmers(hashes: np.ndarray, of: np.ndarray, k: int, m: int, common: np.ndarray):
    """(minimiser, hash of all words, first window, windows) of each super-k-mer of words with documents ``of``, in one piece of under 2^20 words."""
    n = len(hashes) - k + 1
    assert len(hashes) <= int(PLACE)
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none
    grams = gram_hashes(hashes, m)
    least = (common[bucket(grams)].astype(np.uint64) << np.uint64(58)) | ((grams >> np.uint64(6)) & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = k - m + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    place = (least[at] & PLACE).astype(np.int64)
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    first, count = at[cuts], np.diff(cuts, append=len(at))
    power, inverse = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    whole = mix((sums[first + count + k - 1] - sums[first]) * inverse[first] + count.astype(np.uint64))
    return grams[place[cuts]], whole, first, count


def pieces(texts: list[bytes]):
    """(bytes, first row, row after the last, or None for one long text): texts to be looked at together.

    A long text stands alone, to be read in parts.
    """
    row = 0
    while row < len(texts):
        to, total = row, 0
        while to < len(texts) and total + len(texts[to]) < PIECE:
            total += len(texts[to]) + 1
            to += 1
        if to > row:
            yield b"\n".join(texts[row:to]) + b"\n", row, to
            row = to
        else:
            yield texts[row], row, None
            row += 1


def word_runs(texts: list[bytes], k: int):
    """(row or rows, word hashes, document of each word, first word of each document, number of the first word): pieces of some texts.

    Windows of k words lie in exactly one piece: parts of a long text, each hashed once, overlap by k - 1 words. A part holds
    PIECE bytes and what is left of their last word, so it has fewer than 2^20 words, however long a word is.
    """
    for raw, row, to in pieces(texts):
        if to is not None:
            starts, hashes = word_hashes(np.frombuffer(raw, np.uint8))
            begins = np.cumsum([0] + [len(x) + 1 for x in texts[row:to]][:-1])
            of = np.searchsorted(begins, starts, "right") - 1
            yield row, hashes, of, np.searchsorted(of, np.arange(to - row)), 0
            continue
        byte, word, carry = 0, 0, np.zeros(0, np.uint64)
        while byte < len(raw):
            space = NEXT_SPACE(raw, min(byte + PIECE, len(raw)))
            end = space.start() if space else len(raw)
            carry = np.concatenate([carry, word_hashes(np.frombuffer(raw[byte:end] + b"\n", np.uint8))[1]])
            byte = end
            if len(carry) >= k or (byte >= len(raw) and not word):
                yield row, carry, np.zeros(len(carry), np.int64), np.zeros(1, np.int64), word
            over = max(0, len(carry) - (k - 1))
            carry, word = carry[over:], word + over


def document_kmers(texts: list[bytes], k: int, m: int, common: np.ndarray):
    """(row, minimiser, hash, first window, windows) arrays of the super-k-mers of some texts, a piece at a time."""
    for row, hashes, of, first, word in word_runs(texts, k):
        mins, whole, at, n = super_kmers(hashes, of, k, m, common)
        yield of[at] + row, mins, whole, at - first[of[at]] + word, n


def _bits(k: int, m: int) -> tuple[int, int]:
    """Bits of a super-k-mer's windows and of a text's hash, which share the low 32 of its place."""
    n = int(k - m + 1).bit_length()
    return n, 32 - n


def _find(k: int, m: int, shared):
    n_bits, th_bits = _bits(k, m)
    names = ["h", "s", "id", "loc", "salt"]

    def run(batches):
        common, held, size = shared.value, [], 0

        def told():
            """Held super-k-mers; those that repeat an earlier one among them whole are settled and dealt by a salt over 0."""
            h, s, ids, at, rest = (np.concatenate(x) for x in zip(*held))
            held.clear()
            seq = np.lexsort((at, ids, s, h))
            h, s, ids, at, rest = h[seq], s[seq], ids[seq], at[seq], rest[seq]
            new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (ids != ids[lead]) | (at != at[lead])
            salt = np.where(later, (np.arange(len(h)) & 4095) + 1, 0)
            cols = h, s, ids, (at << 32) | rest, salt
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in cols], names=names)

        for batch in batches:
            ids, th, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for at, to in slices(texts):
                for row, mins, whole, first, n in document_kmers(texts.slice(at, to - at).to_pylist(), k, m, common):
                    held.append((mins.view(np.int64), whole.view(np.int64), ids[at:to][row], first, (n << th_bits) | th[at:to][row]))
                    size += len(mins)
                    if size >= HELD:
                        yield from told()
                        size = 0
        if size:
            yield from told()
        release()

    return run


def _pack(k: int):
    names = ["h", "id", "th", "at", "packed"]

    def run(batches):
        for batch in batches:
            ids, th, texts, kmers = batch.column(0), batch.column(1), batch.column(2), batch.column(3)
            for a in range(batch.num_rows):
                words = texts[a].as_py().split()
                own = kmers[a].as_py()
                n = len(own)
                packed = [b" ".join(words[x["at"] : x["at"] + x["n"] + k - 1]) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["h"] for x in own], pa.int64()), pa.array([ids[a].as_py()] * n, pa.int64()), pa.array([th[a].as_py()] * n, pa.int64()), pa.array([x["at"] for x in own], pa.int64()), pa.array(packed, pa.binary())], names=names
                )
        release()

    return run


def _compare(k: int):
    """Rows sorted by minimiser: (id, th, at, n, later), with a 1 in later for each window of a string that starts earlier in another."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("later", pa.binary())])

    def settle(group):
        if len(group) < 2:
            return
        later, windows = [], []
        for s, (_, id_, _, at, packed) in enumerate(group):
            words = packed.split()
            later.append(bytearray(len(words) - k + 1))
            windows += [(b" ".join(words[i : i + k]), id_, at + i, s, i) for i in range(len(words) - k + 1)]
        windows.sort()
        for a, b in zip(windows, windows[1:]):
            if a[0] == b[0] and (a[1:3] != b[1:3] or later[a[3]][a[4]]):
                later[b[3]][b[4]] = 1
        for (_, id_, th, at, _), own in zip(group, later):
            if any(own):
                yield id_, th, at, len(own), bytes(own)

    def run(batches):
        group, now = [], None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    out += settle(group)
                    group, now = [], row[0]
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if out := list(settle(group)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        release()

    return run


def _windows(k: int):
    """(id, th, at, window) of each window of packed strings."""
    names = ["id", "th", "at", "window"]

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 1_000):
                rows = batch.slice(part, 1_000)
                ids, th, at, out = [], [], [], []
                for i, t, a, packed in zip(*(rows.column(c).to_pylist() for c in range(1, 5))):
                    words = packed.split()
                    n = len(words) - k + 1
                    ids += [i] * n
                    th += [t] * n
                    at += range(a, a + n)
                    out += [b" ".join(words[x : x + k]) for x in range(n)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (ids, th, at)], pa.array(out, pa.binary())], names=names)

    return run


def _dealt_out(packed: DataFrame, k: int) -> DataFrame:
    """(id, th, at, n, later) of the windows that start earlier, for strings of minimisers that many share: each window meets the first of its like, which is counted before the shuffle."""
    each = packed.mapInArrow(_windows(k), "id bigint, th bigint, at bigint, window binary")
    first = each.groupBy("window").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("k")).where("k > 1").select("window", "first")
    again = each.join(first, "window").where(F.struct("id", "at") > F.col("first"))
    return again.select("id", "th", "at", F.lit(1).cast("long").alias("n"), F.lit(None).cast("binary").alias("later"))


def _remove(k: int):
    def run(batches):
        for batch in batches:
            keys, texts, marks = batch.column(0), batch.column(1), batch.column(2)
            for at, to in slices(texts, 1_000_000):
                n, gone, kept = [], [], []
                for raw, own in zip(texts.slice(at, to - at).to_pylist(), marks.slice(at, to - at).to_pylist()):
                    words = raw.split()
                    n.append(len(words))
                    if own:
                        step = np.zeros(len(words) + 1, np.int64)
                        for x in own:
                            hit = np.arange(x["n"]) if x["later"] is None else np.flatnonzero(np.frombuffer(x["later"], np.uint8))
                            np.add.at(step, x["at"] + hit, 1)
                            np.add.at(step, np.minimum(x["at"] + hit + k, len(words)), -1)
                        free = np.cumsum(step[:-1]) == 0
                        words = [w for w, f in zip(words, free.tolist()) if f]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["key", "n_words", "n_removed", "kept"])
        release()

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(id, n_words, n_removed, kept_text): each text without the words of windows that also start earlier.

    Earlier is a smaller id, or an earlier word of the same id; all windows are judged on the input. Null and empty texts
    have no words, an empty table gives an empty result. Null ids come before all others, in order of a hash of
    their texts. Rows that share id and text are one document, judged once each; rows that share only the id
    are compared by word number, like parts of it. Ids must be whole numbers. Texts and words may have any length. Only id and
    text are read, whatever other columns there are.

    Text is shuffled once, to meet what was found about its document. Repeats that meet in one task are settled there, so of
    a passage that many documents share each task sends one super-k-mer.
    """
    n_bits, th_bits = _bits(k, m)
    if m > k or th_bits < 16:
        raise ValueError("an m-gram must fit in a window of moderate length")
    hashed, text = F.xxhash64(F.col(text_col).cast("string")), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    least = F.lit(-(1 << 63)).cast("long") + hashed.bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("id"), F.col(id_col).isNull().alias("no_id"), hashed.bitwiseAND(F.lit((1 << th_bits) - 1)).alias("th"), text.alias("text"))
    common = levels(rows.select("text"), lambda texts: (gram_hashes(x[1], m) for x in word_runs(texts, k)))
    shared = docs.sparkSession.sparkContext.broadcast(common)
    found = rows.select("id", "th", "text").mapInArrow(_find(k, m, shared), "h bigint, s bigint, id bigint, loc bigint, salt bigint")
    at, n, th = F.shiftright("loc", 32), F.shiftright("loc", th_bits).bitwiseAND(F.lit((1 << n_bits) - 1)), F.col("loc").bitwiseAND(F.lit((1 << th_bits) - 1))
    order = F.rank().over(Window.partitionBy("h", "salt", "s").orderBy("id", at))
    bucket_ = Window.partitionBy("h", "salt")
    judged = found.withColumn("place", order).withColumn("many", F.min("s").over(bucket_) != F.max("s").over(bucket_)).withColumn("whole", (F.col("salt") > 0) | (F.col("place") > 1)).where("whole or many")
    judged = store(judged.select("h", "id", th.alias("th"), at.alias("at"), n.alias("n"), "whole"))
    texts = rows.select("id", "th", "no_id", "text")  # shuffled once: both joins need the same columns of it
    ask = judged.where("not whole")
    hot = cut(ask.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot")))
    asks = ask.groupBy("id", "th").agg(F.collect_list(F.struct("h", "at", "n")).alias("kmers"))
    packed = texts.join(asks.hint("merge"), ["id", "th"]).select("id", "th", "text", "kmers", "no_id").mapInArrow(_pack(k), "h bigint, id bigint, th bigint, at bigint, packed binary")
    some = hot.limit(1).count() > 0
    if some:
        packed = store(packed.join(hot, "h", "left"))
        out = _dealt_out(packed.where("hot"), k)
        packed = packed.where("hot is null").drop("hot")
    later = packed.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(k), "id bigint, th bigint, at bigint, n bigint, later binary")
    marks = judged.where("whole").select("id", "th", "at", "n", F.lit(None).cast("binary").alias("later")).unionByName(later)
    marks = (marks.unionByName(out) if some else marks).groupBy("id", "th").agg(F.collect_list(F.struct("at", "n", "later")).alias("marks"))
    done = texts.join(marks.hint("merge"), ["id", "th"], "left").select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "text", "marks")
    done = done.mapInArrow(_remove(k), "key bigint, n_words bigint, n_removed bigint, kept binary")
    return done.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
