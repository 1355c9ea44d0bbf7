"""The document operators against plain Python on the same rows."""

import re
from collections import Counter, defaultdict

import pytest

from mnemolith.llm.bpe import bpe_decode, bpe_encode
from mnemolith.llm.jaccard import jaccard_components
from mnemolith.llm.langid import fit, held_out, predict
from mnemolith.llm.licenses import TEMPLATES, scan_licenses
from mnemolith.llm.linededup import dedup_lines
from mnemolith.llm.mixing import mix_sources
from mnemolith.llm.quality import quality_rules
from mnemolith.llm.queries import word_vocabulary
from mnemolith.llm.substrings import dedup_substrings, document_kmers

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.fixture(params=["docs", "clashing"])
def any_docs(request):
    return request.getfixturevalue(request.param)


def test_bpe(any_docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)))
    out = bpe_encode(any_docs, word_vocabulary())
    same([(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()], want)
    same([(r.doc_id, r.decoded) for r in bpe_decode(out, word_vocabulary()).collect()], [(w[0], w[3]) for w in want])


def test_bpe_odd_text(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    texts = ["<|endoftext|>a <|startoftext|>", "It's WE'LL 3² ½", "İstanbul ΑΣ Σ ǅ", "中文\u0085字 😀́", "\x1c\x1d a b", "don't!'s?", "é ﬁ  x"]
    out = bpe_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), word_vocabulary()).collect()
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def base_counts(text):
    words = WORD.findall(text or "")
    n, seen, covered = len(words), Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(n - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base(any_docs, rows):
    got = quality_rules(any_docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(r[0], *base_counts(r[1])) for r in rows])


def test_quality_verdict(spark):
    import random

    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in", "is"]
    long = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(6, 10))) for _ in range(3000)]
    clean = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(long) for _ in range(n)) + "."
    rows = [(i, clean(120), "en") for i in range(100)]
    junk = [(900, " ".join(w + "$$$" for w in clean(80).split()), "en"), (901, " ".join(rng.sample(long, 90)), "en"), (902, clean(90).upper(), "en"), (903, clean(10), "en")]
    out = quality_rules(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in out if not r.kept} == {900, 901, 902, 903}
    assert all(0 <= r.js_classes <= 1 for r in out if r.js_classes is not None)


def test_lines(any_docs, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    where = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            where[key(x)].add(r[0])
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < 10]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    same(dedup_lines(any_docs).select("doc_id", "_n_lines", "_n_dropped", "_kept_text").collect(), want)
    assert sum(w[2] for w in want) > 20


def test_mixing(any_docs, rows):
    out = mix_sources(any_docs).collect()
    sizes = [(r[0], len(WORD.findall(r[1] or ""))) for r in rows]
    same([(r.doc_id, r["size"]) for r in out], sizes)
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += len(WORD.findall(r[1] or ""))
    names = [*sorted(k for k in total if k is not None), None]
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
    for k in names:
        own = [r for r in out if r.source == k]
        assert {r.source_size for r in own} == {total[k]} and abs(own[0].target - target[k]) < 1e-6
        assert abs(sum(r.taken for r in own) - target[k]) <= max(r["size"] for r in own)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in out)
    same([tuple(r) for r in out], [tuple(r) for r in mix_sources(any_docs.repartition(3)).collect()])


def test_substrings(any_docs, rows):
    first, texts = {}, {}
    for i, text in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        words = WORD.findall(text)
        for a in range(len(words) - 19):
            first.setdefault(tuple(words[a : a + 20]), (i, a))
    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        gone = set()
        for a in range(len(words) - 19):
            if first[tuple(words[a : a + 20])] < (r[0], a):
                gone.update(range(a, a + 20))
        want.append((r[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    same(dedup_substrings(any_docs).collect(), want)
    assert sum(w[2] for w in want) > 1000


def test_kmers_of_parts(monkeypatch):
    import numpy as np


    from mnemolith.llm import substrings

    level = np.zeros(1 << 20, np.uint8)
    text = b" ".join(b"%d" % (i * i % 977) for i in range(9000))
    whole = {(h, at + i) for _, m, _, f, n in document_kmers([text], 20, 6, level) for h, at, k in zip(m, f, n) for i in range(k)}
    monkeypatch.setattr(substrings, "PIECE", 3000)
    parts = [(h, at + i) for _, m, _, f, n in document_kmers([text, b"", b"a b"], 20, 6, level) for h, at, k in zip(m, f, n) for i in range(k)]
    assert set(parts) == whole and len(parts) == len(whole) == 9000 - 19


def sets_of(rows):
    out = []
    for r in rows:
        words = WORD.findall((r[1] or "").translate(LOW))
        out.append((r[0], frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()))
    return out


def test_jaccard(any_docs, rows):
    sets = sets_of(rows)
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    same(jaccard_components(any_docs).collect(), [(i, len(x), find(i)) for i, x in sets])
    assert len({find(i) for i, _ in sets}) < len(parent) - 30


def test_language(spark, any_docs):
    import random

    rng = random.Random(4)
    kinds = {"aa": "aeioumn", "bb": "bcdfgkz", "cc": "çéèàôst"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(12)), k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 .;", "bb"), (None, "aeiou", None)], "doc_id long, text string, lang string")
    out = predict(df, fit(df.where(~held_out()))).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert sum(got[i][0] == k for i, _, k in rows) >= 295
    assert got[900] == got[901] == ("und", 0.0) and got[None][0] == "aa" and all(0 <= s <= 1 for _, s in got.values())
    assert {(r.lang_pred, r.score) for r in predict(any_docs, fit(df.limit(0))).collect()} == {("und", 0.0)}


def test_licenses(spark, any_docs):
    rows = [(1, f"x y z\n{TEMPLATES['MIT']} and {TEMPLATES['Apache-2.0']}\nmore"), (2, TEMPLATES["BSD-header"].upper()), (3, "Released under the Apache License"), (4, None), (5, "filler " * 500 + TEMPLATES["MIT-text"][:-30] + " tail" * 500)]
    out = {(r.doc_id, r.license): r.containment for r in scan_licenses(spark.createDataFrame(rows + rows[:1], "doc_id long, text string")).collect()}
    assert set(out) == {(1, "MIT"), (1, "Apache-2.0"), (2, "BSD-header"), (5, "MIT-text")} and 0.8 <= out[5, "MIT-text"] < 1
    assert scan_licenses(any_docs).count() == 0 and scan_licenses(any_docs, {}).count() == 0


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    for f in (lambda d: bpe_encode(d, word_vocabulary()), quality_rules, dedup_lines, mix_sources, dedup_substrings, jaccard_components, scan_licenses, lambda d: predict(d, fit(d))):
        assert f(none).count() == 0




def test_jaccard_blocks(monkeypatch, docs, rows):
    """Small blocks and signatures for all tokens find the same components."""
    from mnemolith.llm import jaccard

    want = sorted(map(tuple, jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    assert sorted(map(tuple, jaccard_components(docs).collect())) == want
