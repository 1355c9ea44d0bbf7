"""The pipeline's five stages against plain Python on the smallest supplied tables, and on tables that are hard."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemolith.llm import oracles
from mnemolith.llm.queries import word_vocabulary
from tests import oracle

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def without_lines(rows):
    """The second stage: (id, text) in order of id."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders, first = defaultdict(set), {}
    for i, text, _ in rows:
        for at, x in enumerate(text.split("\n")):
            holders[key(x)].add(i)
            first.setdefault(key(x), (i, at))
    out = []
    for i, text, source in rows:
        kept = [x for at, x in enumerate(text.split("\n")) if not key(x) or len(holders[key(x)]) < 10 or first[key(x)] == (i, at)]
        if len(kept) == text.count("\n") + 1 or WORD.search("\n".join(kept)):
            out.append((i, "\n".join(kept), source))
    return out


def first_of_groups(rows):
    sets, label = {}, {}
    for i, text, _ in rows:
        w = WORD.findall(text.translate(LOW))
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
        label[i] = i

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows):
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    names = [*sorted(k for k in total if k is not None), *[None] * (None in total)]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, live, left = {}, set(names), float(sum(total.values()))
    while live:
        level = left / sum(weight[k] for k in live)
        over = [k for k in live if weight[k] * level > 3 * total[k]]
        for k in over or live:
            target[k] = 3 * total[k] if over else weight[k] * level
        if not over:
            break
        left -= sum(target[k] for k in over)
        live -= set(over)
    out = []
    for k in names:
        own = sorted((size[i], int(md5(f"{i}:{md5(t)}")[:5], 16) % 1024, i, t) for i, t, s in rows if s == k)
        rate = min(3.0, target[k] / total[k]) if total[k] else 0.0
        offset = int(md5("0:" + ("b" if k is None else "a" + k))[:5], 16) / 2**20
        for r, (_, _, i, t) in enumerate(own):
            out += [(i, t)] * min(3, int((r + 1) * rate + offset) - int(r * rate + offset))
    return out


@pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")
def test_pipeline_by_hand(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    con, library = oracle.connect(DATA), Tokenizer.from_file(word_vocabulary())
    rows = con.sql(f"SELECT doc_id, text, source FROM documents SEMI JOIN (SELECT doc_id FROM ({oracles.QUALITY}) WHERE kept) USING (doc_id) ORDER BY doc_id").fetchall()
    ready = [len(rows)]
    for stage in (without_lines, first_of_groups, mixed):
        rows = stage(rows)
        ready.append(len(rows))
    want = []
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), library.decode(ids, skip_special_tokens=False)))
    out = corpus_pipeline.run(spark, str(DATA))
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()) == Counter(want)
    assert 100 < ready[0] < 200 and ready[2] < ready[1]


def test_stages_by_name(spark, docs):
    """Columns that have names of helper columns come through, as do rows without them; an empty table stays empty."""
    import corpus_pipeline

    names = ["_row", "_kept", "_th", "_id", "_tid", "_tth", "_copies", "copies", "col", "_k", "_n_dropped", "_kept_text", "_n_lines", "_text", "_words", "size"]
    clash = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        plain, wide = stage(spark, docs, ""), stage(spark, clash, "")
        assert sorted(map(str, wide.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert wide.columns == clash.columns
            assert wide.where(" or ".join(f"`{n}` != concat('{n}:', coalesce(cast(doc_id as string), ''))" for n in names)).count() == 0
        assert stage(spark, clash.limit(0), "").count() == 0
