"""Texts and tables that are hard in one way: enormous words, lines and documents, hot keys, odd markup."""

import random
import time

from pyspark.sql import functions as F

import pytest

from mnemolith.llm import langid, substrings
from mnemolith.llm.html import extract_text, main_text
from mnemolith.llm.licenses import scan_licenses
from mnemolith.llm.linededup import dedup_lines
from mnemolith.llm.substrings import dedup_substrings, word_hashes


def test_a_word_longer_than_a_piece(spark):
    """Windows behind a word of over a piece, and of a million words more, are found as any others."""
    passage = " ".join(f"p{i}" for i in range(60))
    filler = " ".join(f"{i:x}" for i in range(1_100_000))
    texts = [f"{passage} own", f"{'x' * (1 << 20)} a {passage} b {filler} {passage} c", "y" * (3 << 20), f"{'z ' * 10}{'w' * (1 << 21)} {passage}"]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()}
    assert out == {0: (61, 0), 1: (1_100_124, 120), 2: (1, 0), 3: (71, 60)}


def test_word_hashes_of_blocks(monkeypatch):
    import numpy as np

    rng = random.Random(3)
    raw = np.frombuffer(b" ".join(b"ab"[rng.randrange(2) :] * rng.randint(1, 40) for _ in range(500)) + b"\n", np.uint8)
    whole = word_hashes(raw)
    monkeypatch.setattr(substrings, "PIECE", 7)
    parts = word_hashes(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_hot_minimisers(monkeypatch, docs):
    """Buckets that are taken apart by window give what whole buckets do."""
    want = sorted(map(tuple, dedup_substrings(docs).collect()))
    monkeypatch.setattr(substrings, "HOT", 1)
    assert sorted(map(tuple, dedup_substrings(docs).collect())) == want


def test_ids_that_are_null_or_repeat(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None, f"a {passage}"), (None, f"b {passage}"), (1, f"c {passage}"), (1, f"{passage} d e"), (1, f"{passage} d e"), (2, None)]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    nulls = sorted(r.n_removed for r in out if r.doc_id is None)
    assert nulls == [0, 30] and sorted(r.n_removed for r in out if r.doc_id == 1) == [30, 30, 30] and len(out) == 6


def test_many_lines(spark):
    """Time is linear in the lines that go: ten documents of 200,000 common lines."""
    numbers = F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: F.concat(F.lit("line "), x.cast("string")))
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.col("id").cast("string"), F.lit("\n"), F.array_join(numbers, "\n")).alias("text"))
    start = time.time()
    out = dedup_lines(docs).select("doc_id", "_n_lines", "_n_dropped", "_kept_text").collect()
    assert sorted(map(tuple, out)) == [(i, 200_001, 200_000, f"own {i}") for i in range(10)]
    assert time.time() - start < 60


def test_lines_by_join(monkeypatch, docs):
    """Bitmaps that are too large to broadcast meet the text in a join."""
    from mnemolith.llm import linededup

    want = sorted(map(str, dedup_lines(docs).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    assert sorted(map(str, dedup_lines(docs).collect())) == want


def test_first_lines_stay(spark):
    rows = [(i, f"head {i}\nshared\n x \nshared") for i in range(12)]
    out = {r.doc_id: r._kept_text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).collect()}
    assert out[0] == "head 0\nshared\n x " and all(out[i] == f"head {i}" for i in range(1, 12))


HOSTILE = {
    "nested": "<div>" * 5000, "nested text": "<div>a b c" * 5000, "inline": "<b>" * 5000 + "</b>" * 5000, "inline text": "<b>x" * 5000, "quotes": "<a '" * 8000, "values": '<a b="' * 8001,
    "brackets": "<" * 50_000, "names": "<a" * 50_000, "items": "<blockquote>" * 3000 + "<li>x" * 3000, "buttons": "<button>x" * 5000, "comments": "<!--x" * 5000,
    "spans": "<svg><title>" * 4000, "equals": "<a =" + "= " * 20_000, "ends": "<div>" * 5000 + "</span>" * 5000 + "</p>" * 5000, "crossed": "<b><div>" + "<i>" * 5000 + "</b>" * 5000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    start = time.time()
    main_text(HOSTILE[name])
    assert time.time() - start < 1


def site(names, texts):
    """Pages whose parts are told apart by class names only: a menu, an advert that changes, the article, a footer."""
    menu, ad, article, foot = names
    for i, text in enumerate(texts):
        yield i, f"http://site.example.com/{i}", f'<body><div class="{menu}"><a href="/">Home</a> <a href="/x">All</a></div><div class="{ad}">Buy number {i * 7919 % 1000} now.</div><div class="{article}"><h1>T{i}</h1><p>{text}</p></div><div class="{foot}">Made by us</div></body>'


@pytest.mark.parametrize("names", [("z0", "z1", "z2", "z3"), ("x101", "x102", "x103", "x104"), ("qa", "qb", "qc", "qd")])
def test_names_tell_slots_apart(spark, names):
    texts = [f"Words of page {i} that no other page has, " + " ".join(f"w{i}{j}" for j in range(20)) for i in range(8)]
    out = extract_text(spark.createDataFrame(list(site(names, texts)), "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"T{i} {t}" for i, t in enumerate(texts)}


def test_numbered_elements(spark):
    texts = [" ".join(f"w{i}{j}" for j in range(40)) for i in range(8)]
    rows = [(i, u, h.replace('class="post"', f'class="post" id="post-{i * 37}"')) for i, u, h in site(("menu1", "ad1", "post", "foot1"), texts)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"T{i} {t}" for i, t in enumerate(texts)}


def test_words_of_a_small_host(spark):
    """What all pages of a host repeat inside the article is the template's, also on a host of three pages."""
    texts = [" ".join(f"w{i}{j}" for j in range(60)) + "</p><p>Read more on our site.</p><ul><li><a href='/r'>Related one</a><li><a href='/s'>Related two</a></ul><p>end " + f"{i}" for i in range(3)]
    rows = [(i, u, h.replace("<body>", "<html><head><meta charset=x><title>t<body>")) for i, u, h in site(("m", "a", "b", "f"), texts)]
    out = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"T{i} " + " ".join(f"w{i}{j}" for j in range(60)) + f" end {i}" for i in range(3)}


def test_pages_with_other_columns(spark):
    rows = [(i, u, h) for i, u, h in site(("m", "a", "b", "f"), ["some words here"] * 4)] + [(9, "http://site.example.com/9", None), (None, None, "<p>x"), (10, "no host", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.withColumns({n: F.lit("x") for n in ("host", "token", "template", "key", "text", "parent", "kind")})
    want = sorted(map(str, extract_text(pages).collect()))
    assert sorted(map(str, extract_text(clash).collect())) == want and len(want) == 7
    assert extract_text(pages.limit(0)).collect() == []


def test_unclosed_elements():
    assert main_text("<html><head><title>T</title><p>one <button>two <p>three</p><select>four") == "one two three four"
    assert main_text("<p>one <button>two</button> three <svg><path></svg>four<script>five") == "one three four"
    assert main_text("<p>one<!-- two --> three <p title='a > b'>four <p title=it's>five") == "one three four five"


def grams_of(text):
    """Buckets of all n-grams of a text, one character at a time."""
    run = []
    for c in text:
        if c.isalpha():
            run.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif run and run[-1] != 32:
            run.append(32)
    if run and run[-1] != 32:
        run.append(32)
    out = []
    for n in (1, 2, 3):
        for i in range(len(run) - n + 1):
            h = 2166136261
            for x in run[i : i + n]:
                h = (h ^ x) * 16777619 % 2**32
                h ^= h >> 13
            out.append(h * 2654435761 % 2**32 >> 16)
    return out


def test_language_by_hand(spark, monkeypatch):
    """Predictions and scores are those of naive Bayes counted one n-gram at a time, with pieces and parts of any size."""
    import math
    from collections import Counter

    rng = random.Random(8)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "ghijé", "dd": "xyzßA", "ee": "aeiou"}
    rows = [(i, "".join(rng.choice(kinds[k] + "  1.") for _ in range(rng.randint(0, 40))), k) for i, k in enumerate(rng.choices(list(kinds), k=120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, prior = {k: Counter() for k in kinds}, Counter(k for _, _, k in rows)
    for _, text, k in rows:
        counts[k].update(grams_of(text))
    want = {}
    for i, text, _ in rows:
        own = grams_of(text)
        logs = {k: math.log(prior[k] / 120) + sum(math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * 65536)) for g in own) for k in kinds}
        best = max(logs, key=logs.get)
        want[i] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())) if own else ("und", 0.0)

    def check(pieces):
        out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df)).collect()}
        assert all(out[i][0] == want[i][0] and abs(out[i][1] - want[i][1]) < 1e-9 for i in want)
        for text in [t for _, t, _ in rows] + ["ab1", "ab1cd", "1", "a" * 40, "a1 " * 20]:
            monkeypatch.setattr(langid, "PIECE", pieces)
            assert (langid.features([text, "x"]) == sum(np.bincount([g], minlength=65536) for g in grams_of(text) + grams_of("x"))).all()

    import numpy as np

    check(3)
    monkeypatch.setattr(langid, "PART", 2)
    monkeypatch.setattr(langid, "GATHERED", 64)
    check(1)


def test_licenses_of_any_length(spark, monkeypatch):
    """Templates of one word to some thousands, found wherever they begin, in one pass or several."""
    from mnemolith.llm import licenses

    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    sizes = {"one": 1, "three": 3, "five": 5, "nine": 9, "window": 256, "long": 700, "longer": 3000}
    templates = {name: " ".join(f"{name}{rng.choice(words)}" for _ in range(n)) for name, n in sizes.items()} | {"none": " .. "}
    rows, want = [], set()
    for i, (name, text) in enumerate((name, text) for name, text in templates.items() for _ in range(6)):
        before = " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))
        rows.append((i, f"{before} {text.upper()}, {before}"))
        want |= {(i, name)} if name != "none" else set()
    half = templates["long"].split()
    rows.append((99, " ".join(half[:350])))  # half of a template
    rows.append((100, " ".join(half[: int(len(half) * 0.9)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (licenses.PART, 50):
        monkeypatch.setattr(licenses, "PART", part)
        out = {(r.doc_id, r.license): r.containment for r in scan_licenses(df, templates).collect()}
        assert set(out) == want | {(100, "long")} and all(out[x] == 1 for x in want)


def test_licenses_by_hand(spark):
    """Containments and places are those of all windows looked at one by one."""
    from mnemolith.llm.licenses import TEMPLATES

    rng = random.Random(9)
    pool = [w for t in TEMPLATES.values() for w in t.split()] + ["x", "y"]
    texts = []
    for _ in range(60):
        own = rng.choice(list(TEMPLATES.values())).split()
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(pool)
        texts.append(" ".join([rng.choice(pool) for _ in range(rng.randint(0, 60))] + own + [rng.choice(pool) for _ in range(30)]))
    cut = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    want = {}
    for i, text in enumerate(texts):
        words = cut(text)
        for name, template in TEMPLATES.items():
            t = cut(template)
            k, size = min(5, len(t)), max(8, 1 << (len(t) - 1).bit_length())
            wanted = {tuple(t[a : a + k]) for a in range(len(t) - k + 1)}
            all_ = [tuple(words[a : a + k]) for a in range(len(words) - k + 1)]
            for at in range(0, len(all_), size // 2):
                c = len(wanted & set(all_[at : at + 3 * size // 2 - k + 1])) / len(wanted)
                if c >= 0.8:
                    best, first = want.get((i, name), (0, at))
                    want[i, name] = max(best, c), first
    out = {(r.doc_id, r.license): (r.containment, r.first_word) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == want and len(want) > 25


def test_top_k_of_huge_components(spark):
    """Components and scores beyond 64 bits count as the last number; nothing fails, and other queries are as they were."""
    from mnemolith.llm.vafile import top_k

    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.5]), (3, [2.0, 3.0]), (20, [1.0, 0.25]), (21, [0.0, 1e18]), (40, []), (41, []), (42, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("x") for n in ("dim", "ids", "v", "score", "block")})
    out = {}
    for r in top_k(df, df.where("vec_id % 20 = 0"), k=3).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    last = 2**63 - 1
    assert sorted(out[0]) == [(1, 1, last), (2, 3, last), (3, 20, last)]
    assert sorted(out[40]) == [(1, 41, 0)]
    big = 2**62
    want = sorted([(-min(last, 64 * big + 16 * 64), 0), (-min(last, 64 * big - 16 * 64), 1), (-(64 * 128 + 16 * 192), 3), (-min(last, 16 * big), 21)])[:3]
    assert [(x[1], x[2]) for x in sorted(out[20])] == [(i, -s) for s, i in want]


def test_top_k_of_many_blocks(spark, monkeypatch):
    """Small blocks, groups and shares give what brute force does."""
    import numpy as np

    from mnemolith.llm import vafile

    for name, n in (("BLOCK", 16), ("GROUP", 2), ("SHARE", 1), ("AT_ONCE", 3)):
        monkeypatch.setattr(vafile, name, n)
    values = np.random.default_rng(5).normal(size=(300, 8)).round(1)
    whole = np.floor(64 * values).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    out = sorted(map(tuple, vafile.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect()))
    want = []
    for q in range(0, 300, 20):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(300) if i != q)[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert out == want


def test_bpe_of_long_words():
    """Words of thousands of letters, and runs of one letter, are merged as the library merges them, in a moment."""
    from tokenizers import Tokenizer

    from mnemolith.llm.bpe import coder
    from mnemolith.llm.queries import word_vocabulary

    rng = random.Random(2)
    library, bpe = Tokenizer.from_file(word_vocabulary()), coder(word_vocabulary())
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("etaoinshrdlu", "ab", "a", "éß字中") for n in (1, 2, 3, 7, 66, 67, 100, 199, 200, 201, 5000)]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(500)), "aaa aaaaa aaaaaaa " * 3]
    for text, (ids, said) in zip(texts, bpe.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in want) and said == library.decode(want, skip_special_tokens=False)
    start = time.time()
    bpe.encode(["".join(rng.choice("etaoinshrdlu") for _ in range(300_000))])
    assert time.time() - start < 20


def test_bpe_of_long_texts(monkeypatch):
    from tokenizers import Tokenizer

    from mnemolith.llm import bpe
    from mnemolith.llm.queries import word_vocabulary

    rng = random.Random(4)
    text = "".join(rng.choice(["the ", "ing", "\n", " don't", "12", "<|endoftext|>", "É", "  "]) for _ in range(5000))
    want = Tokenizer.from_file(word_vocabulary()).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "SLICE_CHARS", 100)
    coder = bpe.SpeculativeBPE(word_vocabulary())
    (ids, said), (none, nothing) = coder.encode([text, ""])
    assert ids == b"".join(i.to_bytes(4, "little") for i in want) and said == Tokenizer.from_file(word_vocabulary()).decode(want, skip_special_tokens=False)
    assert (none, nothing) == (b"", "")
