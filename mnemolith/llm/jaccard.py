"""Operator 10: n-gram Jaccard join by grouped prefixes.

Tokens are ordered by how common they are, told by a counting sketch over the whole corpus. Two sets that reach the
threshold share some of the first tokens in this order, their prefixes; prefixes are l - 1 tokens longer than
needed for one common token, so that such sets share l of them, which few others do. Documents with equal sets are
one; sets with identical prefix and size are one group, which is what meets at tokens. Pairs of groups are filtered by
size, position and number of common prefix tokens, then expanded to members; a parity signature of each set, a bit or
two for each shingle, bounds the difference of two sets from below and refuses most of the rest, and what is left is
verified on the texts.

All links between components are found, though not each pair of a large group: first every holder of a token is compared
to one centre of that token, which is linear; then, for tokens whose holders are still in different components, all
pairs across components. A pair inside one component can't change it and is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, drop, release, store
from .components import components
from .sketch import bucket, levels
from .substrings import ODD, PIECE, mix, word_hashes

N, PERCENT = 4, 85
#: Token rows told apart together, and holders of a token in a block of the pair search.
HELD, BLOCK = 500_000, 1_000
#: A token that more groups hold brings their signatures to the pair search, which then tells of no pair that they refuse.
HOT = 32
#: Pairs of holders, by count of tokens, that a task of the pair search gets on average.
PAIRS = 250_000
#: Ids up to this number are broadcast (8 bytes each) to pick out candidate texts; more of them meet the texts in a join.
BROADCAST_IDS = 1_000_000
#: A prefix has one more token for so many shingles; a group's key has its size in the low bits.
MORE, SIZE_BITS = 60, 20
SIZE_MASK = (1 << SIZE_BITS) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(texts: list[bytes], n: int = N):
    """(row, shingle) arrays, repeats included, of texts taken some at a time: (first row, rows, of, hashes)."""
    row = 0
    while row < len(texts):
        to, total = row, 0
        while to < len(texts) and (to == row or total + len(texts[to]) < PIECE) and to - row < 4000:
            total += len(texts[to]) + 1
            to += 1
        data = LOWER[np.frombuffer(b"\n".join(texts[row:to]) + b"\n", np.uint8)]
        starts, words = word_hashes(data)
        begins = np.cumsum([0] + [len(x) + 1 for x in texts[row:to]][:-1])
        of = np.searchsorted(begins, starts, "right") - 1
        count = np.bincount(of, minlength=to - row)
        grams = words[: max(0, len(words) - n + 1)].copy()
        for j in range(1, n):
            grams = grams * ODD + words[j : len(words) - n + 1 + j]
        whole = np.flatnonzero(of[: len(grams)] == of[n - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
        parts, owners = [mix(grams[whole])], [of[whole]]
        first = np.cumsum(count) - count
        for short in range(1, n):
            at = np.flatnonzero(count == short)
            if len(at):
                h = words[first[at]].copy()
                for j in range(1, short):
                    h = h * ODD + words[first[at] + j]
                parts.append(mix(h + np.uint64(short)))
                owners.append(at)
        yield row, to, np.concatenate(owners), np.concatenate(parts)
        row = to


def shingle_sets(rows: DataFrame, order: np.ndarray, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(id, n, d1, d2, g, prefix, sig): size and digest of each set, its group, prefix and parity signature. rows: (id, text as binary).

    A group's key has the commonness of the set, 36 bits of the prefix's digest, and the size; groups that meet by chance are told apart by their members.
    """
    shared = rows.sparkSession.sparkContext.broadcast(order)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("g", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        common = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, to in slices(texts):
                for row, end, of, h in shingles(texts.slice(at, to - at).to_pylist(), n):
                    docs = end - row
                    level = common[bucket(h)].astype(np.uint64)
                    seq = np.argsort(h)
                    seq = seq[np.argsort(((of.astype(np.uint64) << np.uint64(6)) | level)[seq], kind="stable")]
                    of, h = of[seq], h[seq]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                    of, h = of[new], h[new]
                    size = np.bincount(of, minlength=docs)
                    first = np.cumsum(size) - size

                    def digest(v, of=of, docs=docs):
                        total = np.zeros(docs, np.uint64)
                        if len(v):
                            cuts = np.flatnonzero(np.diff(of, prepend=-1))
                            total[of[cuts]] = np.add.reduceat(v, cuts)
                        return total

                    keep = np.where(size > 0, np.minimum(size, size - (percent * size + 99) // 100 + 1 + size // MORE), 0)
                    inside = np.arange(len(h)) - first[of] < keep[of]
                    prefix, owner = h[inside], of[inside]
                    # the more common a set's shingles, the less its group's key: an original comes before its edited copies
                    level = level[seq][new]
                    rare = 127 - np.minimum(127, 4 * digest(level).astype(np.int64) // np.maximum(size, 1)).astype(np.uint64)
                    group = (rare << np.uint64(56)) | ((digest(mix(prefix), owner) >> np.uint64(28)) << np.uint64(SIZE_BITS)) | np.minimum(size, SIZE_MASK).astype(np.uint64)
                    offsets = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                    # parity of the shingles that fall on each bit; a power of two bits, one to two for each shingle
                    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
                    begin = np.concatenate([[0], np.cumsum(bits)])
                    place = begin[:-1][of] + (mix(h) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
                    parity = np.packbits((np.bincount(place, minlength=begin[-1]) & 1).astype(np.uint8)).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(at + row, end - row), pa.array(size), pa.array(digest(mix(h)).view(np.int64)), pa.array(digest(mix(h ^ ODD)).view(np.int64)), pa.array(group.view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix.view(np.int64))), pa.array([parity[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary()),
                        ],
                        schema=schema,
                    )
        release()

    return rows.select("id", "text").mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, g bigint, prefix array<bigint>, sig binary")


def holders(sets: DataFrame) -> DataFrame:
    """(token, g, pos, centre): the groups that hold each token that more than one holds, with a group to compare each to first.

    Groups that meet in one task are compared to one of them, and only that one goes on to meet those of other tasks;
    so a token that a third of all groups hold sends one row from each task.
    """
    names = ["token", "g", "centre", "pos"]

    def run(batches):
        held, size = [], 0

        def told():
            token, g, pos = (np.concatenate(x) for x in zip(*held))
            held.clear()
            seq = np.lexsort((g, token))
            token, g, pos = token[seq], g[seq], pos[seq]
            one = np.append(True, (token[1:] != token[:-1]) | (g[1:] != g[:-1]))  # equal sets send one row
            token, g, pos = token[one], g[one], pos[one]
            new = np.append(True, token[1:] != token[:-1])
            centre = g[np.flatnonzero(new)][np.cumsum(new) - 1]
            several = np.flatnonzero(new & ~np.append(new[1:], True))  # a second row of such a centre tells all others
            for part in ((token, g, centre, pos), [x[several] for x in (token, g, centre)] + [np.full(len(several), -1)]):
                for i in range(0, len(part[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in part], names=names)

        for batch in batches:
            lists = batch.column(1)
            count = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            held.append((token, np.repeat(batch.column(0).to_numpy(), count), np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)))
            size += len(token)
            if size >= HELD:
                yield from told()
                size = 0
        if size:
            yield from told()
        release()

    rows = sets.select("g", "prefix").mapInArrow(run, "token bigint, g bigint, centre bigint, pos bigint")
    rows = rows.withColumn("salt", F.when(F.col("g") == F.col("centre"), 0).otherwise(F.pmod(F.hash("g"), F.lit(4096)) + 1))
    own = Window.partitionBy("token", "salt")
    least, some = F.min("g").over(own), (F.min("g").over(own) != F.max("g").over(own)) | (F.min("pos").over(own) < 0)
    rows = rows.withColumn("least", least).withColumn("some", some).where("pos >= 0 and (salt > 0 or some)")
    # a centre of several is compared to the least of all such centres
    return rows.select("token", "g", "pos", F.when(F.col("salt") > 0, F.col("centre")).otherwise(F.col("least")).alias("centre"))


def size_of(g: Column) -> Column:
    return g.bitwiseAND(F.lit(SIZE_MASK))


def in_reach(g1: Column, g2: Column, percent: int) -> Column:
    """Whether the sizes of two groups allow a link; a size beyond the mask is not known."""
    n1, n2 = size_of(g1), size_of(g2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) | (F.greatest(n1, n2) == SIZE_MASK)


def in_common(g1: Column, g2: Column) -> Column:
    """Prefix tokens that linked sets of two groups share at least."""
    return F.least(size_of(g1), size_of(g2)) / F.lit(MORE) + 1


def signed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, n1, n2, s1, s2) whose parity signatures allow a link: a difference of d shingles leaves at most d odd places."""

    def differ(a: bytes, b: bytes) -> int:
        if len(a) < len(b):
            a, b = b, a
        x, size = int.from_bytes(a, "big"), len(a) * 8
        while size > len(b) * 8:  # folded, it is the signature of fewer bits
            size //= 2
            x = (x >> size) ^ (x & ((1 << size) - 1))
        return (x ^ int.from_bytes(b, "big")).bit_count()

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            odd = np.array([differ(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield batch.filter(pa.array((100 + percent) * odd <= (100 - percent) * n)).select(["u", "v"])

    return pairs.select("u", "v", "n1", "n2", "s1", "s2").mapInArrow(run, "u bigint, v bigint")


def verify(pairs: DataFrame, texts: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of ids whose texts link. Each pair meets its two texts in a join; sets of a batch are compared together."""

    def unique(texts_):
        out = []
        for row, _, of, h in shingles(texts_, n):
            both = np.stack([(of + row).astype(np.uint64), h])[:, np.lexsort((h, of))]
            out.append(both[:, np.append(True, (both[:, 1:] != both[:, :-1]).any(0))] if both.shape[1] else both)
        return np.concatenate(out, 1)

    def run(batches):
        for batch in batches:
            for at, to in slices(batch.column(3), 2_000_000):
                a, b = (unique(batch.column(i).slice(at, to - at).to_pylist()) for i in (2, 3))
                rows = to - at
                n1, n2 = (np.bincount(x[0].astype(np.int64), minlength=rows) for x in (a, b))
                both = np.concatenate([a, b], 1)
                both = both[:, np.lexsort((both[1], both[0]))]
                same = both[0, 1:][(both[:, 1:] == both[:, :-1]).all(0)].astype(np.int64)
                inter = np.bincount(same, minlength=rows)
                good = np.flatnonzero((inter > 0) & (100 * inter >= percent * (n1 + n2 - inter)))
                if len(good):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at).take(pa.array(good)), batch.column(1).slice(at, to - at).take(pa.array(good))], names=["u", "v"])

    one, two = texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), texts.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    return pairs.join(two, "v").join(one, "u").select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint")


def crossing(held: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(g1, l1, g2, l2): pairs of groups of different labels that share enough tokens and pass the filters.

    held: (token, g, pos); named: (g, label, sig). Holders of a token are dealt to blocks, and pairs of blocks to tasks; in a task
    they are taken in order of size, each with those in reach. Those of tokens that many hold have signatures.
    """
    rows = held.join(named.select("g", "label").distinct(), "g")
    spread = cut(rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo != hi").select("token", "k"))
    few = rows.join(spread.where(F.col("k") <= HOT), "token").withColumn("sig", F.lit(None).cast("binary"))
    many = held.join(spread.where(F.col("k") > HOT), "token").join(named.select("g", "label", "sig").distinct(), "g")
    cols = ["token", "g", "pos", "label", "sig", "k"]
    dealt = few.select(*cols).unionByName(many.select(*cols)).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "g", "label", "pos", "sig")

    def refused(sigs, n):
        """For entry a and others, those whose signatures refuse a link."""
        words = [None if x is None else np.frombuffer(x, np.uint64) for x in sigs]
        size = np.array([0 if w is None else len(w) for w in words])
        whole = {L: np.stack([w if len(w) == L else np.zeros(L, np.uint64) for w in words]) for L in set(size.tolist()) - {0}} if (size > 0).all() else {}

        def of(a, at):
            bad = np.zeros(len(at), bool)
            for L, s in whole.items():
                if L not in (size[a], 2 * size[a]):
                    continue
                own = np.flatnonzero((size[at] == L) & (n[at] < SIZE_MASK))
                if len(own):
                    other = s[at[own]]
                    if L == 2 * size[a]:
                        other = other[:, : L // 2] ^ other[:, L // 2 :]
                    odd = np.bitwise_count(other ^ words[a]).sum(1).astype(np.int64)
                    bad[own] = (100 + percent) * odd > (100 - percent) * (n[a] + n[at[own]])
            return bad

        return of

    def run(batches):
        group, now = [], None

        def pairs():
            seq = sorted(range(len(group)), key=lambda i: group[i][4] & SIZE_MASK)
            own, g, label, pos = np.array([group[i][3:7] for i in seq], np.int64).T
            n = g & SIZE_MASK
            no = refused([group[i][7] for i in seq], n)
            reach = np.where(n == SIZE_MASK, len(n), np.searchsorted(n, n * 100 // percent, "right"))
            unknown = np.searchsorted(n, SIZE_MASK)
            out = []
            for a in range(len(n) - 1):
                at = np.arange(a + 1, reach[a])
                if unknown < len(n):
                    at = np.union1d(at, np.arange(max(a + 1, unknown), len(n)))
                need = (percent * (n[a] + n[at]) + percent + 99) // (100 + percent)
                # the j-th common token leaves j - 1 before it, and the first few are those that count
                left = np.minimum(n[a] - pos[a], n[at] - pos[at]) + np.minimum(n[a], n[at]) // MORE
                ok = (label[at] != label[a]) & ((left >= need) | (n[at] == SIZE_MASK))
                if now[1] != now[2]:
                    ok &= own[at] != own[a]
                at = at[ok]
                at = at[~no(a, at)]
                if len(at):
                    flip = g[at] < g[a]
                    out.append(np.stack([np.where(flip, g[at], g[a]), np.where(flip, label[at], label[a]), np.where(flip, g[a], g[at]), np.where(flip, label[a], label[at])]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], names=["g1", "l1", "g2", "l2"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    if len(group) > 1:
                        yield from pairs()
                    group, now = [], row[:3]
                group.append(row)
        if len(group) > 1:
            yield from pairs()
        release()

    work = spread.agg(F.sum(F.col("k") * F.col("k") / 2)).first()[0] or 0  # tasks by pairs: of bytes there are few
    found = dealt.repartition(1 + int(work // PAIRS), "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "g1 bigint, l1 bigint, g2 bigint, l2 bigint")
    common = found.groupBy("g1", "l1", "g2", "l2").agg(F.count("*").alias("k"))
    return common.where(F.col("k") >= F.floor(in_common(F.col("g1"), F.col("g2")))).drop("k")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    A text's set: its distinct n-word shingles, A-Z lower-cased; all its words as one if there are fewer; nothing for a null text or
    one without words, which links with nothing and is its own component. Two documents link if intersection is
    percent of union or more. component_id: the least id that links reach. Sets are compared by 64-bit hashes of shingles.
    Repeated rows come out alike; of rows that share an id but not the text, each goes by its own set. Ids are
    whole numbers; null ids link with nothing and have a null component. Texts have any length, and a set any number of shingles; an
    empty table gives an empty result; only id and text are read, whatever other columns there are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    order = levels(rows.where("id is not null").select("text"), lambda texts: (h for _, _, _, h in shingles(texts, n)))
    sets = store(shingle_sets(rows, order, n, percent))
    usable = sets.where("n > 0 and id is not null")
    held = store(holders(usable))
    # one member for each different set of a group
    members = store(usable.groupBy("d1", "d2", "n", "g").agg(F.min("id").alias("rep"), F.max("sig").alias("sig")))
    heads = members.join(members.groupBy("g").agg(F.min("rep").alias("rep"), F.count("*").alias("k")), ["g", "rep"]).select("g", "rep", "n", "sig", "k")

    def side(df, i, extra=()):
        return df.select(F.col("g").alias(f"g{i}"), F.col("rep").alias("uv"[i - 1]), F.col("n").alias(f"n{i}"), F.col("sig").alias(f"s{i}"), *extra)

    def texts_of(pairs):
        ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return store(rows.where("id is not null").join(F.broadcast(ids) if few else ids, "id", "left_semi"))

    g1, g2 = F.col("g1"), F.col("g2")
    star = held.where("g != centre").groupBy(F.col("centre").alias("g1"), F.col("g").alias("g2")).agg(F.count("*").alias("k")).where(in_reach(g1, g2, percent) & (F.col("k") >= F.least(F.lit(2), F.floor(in_common(g1, g2))))).select("g1", "g2")
    star = star.join(side(heads, 1), "g1").join(side(heads, 2), "g2")
    inside = side(heads.where("k > 1"), 1).join(side(members, 2), g1 == g2).where("u != v")
    pairs = cut(signed(star.unionByName(inside.select(*star.columns)), percent).distinct())
    texts = texts_of(pairs)
    links = cut(verify(pairs, texts, n, percent))
    drop(texts)
    labels = components(links)
    named = cut(members.select("g", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("g", "rep", F.coalesce("label", "rep").alias("label")))
    full = members.select("g", "rep", "n", "sig").join(named, ["g", "rep"])
    cross = crossing(held.select("token", "g", "pos"), full, percent)
    m1, m2 = side(full, 1, [F.col("label").alias("l1")]), side(full, 2, [F.col("label").alias("l2")])
    across = cross.join(m1, ["g1", "l1"]).join(m2, ["g2", "l2"])
    mixed = named.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("g")
    within = m1.join(mixed, F.col("g1") == F.col("g"), "left_semi").join(m2, g1 == g2).where("u < v and l1 != l2")
    pairs = cut(signed(across.unionByName(within.select(*across.columns)), percent).distinct())
    drop(held)
    texts = texts_of(pairs)
    found = cut(verify(pairs, texts, n, percent))
    drop(texts)
    # what is known of components stands for its links
    final = components(found.unionByName(labels.where("id != label").select(F.col("id").alias("u"), F.col("label").alias("v")))) if found.limit(1).count() else labels
    label = members.select("d1", "d2", "n", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("label", "rep").alias("label"))
    out = sets.select("id", "n", "d1", "d2").join(label, ["d1", "d2", "n"], "left")
    kind = docs.schema[id_col].dataType
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("label")).otherwise(F.col("id"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
