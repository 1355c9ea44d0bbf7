"""Properties over generated texts, without Spark."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemolith.llm import jaccard, langid, substrings
from mnemolith.llm.bpe import coder
from mnemolith.llm.common import text_slices
from mnemolith.llm.html import blocks, main_text
from mnemolith.llm.queries import word_vocabulary

BPE, LIBRARY = coder(word_vocabulary()), Tokenizer.from_file(word_vocabulary())
TEXT = st.text(st.characters(codec="utf-8"), max_size=200) | st.lists(st.sampled_from(["hello", "don't", " ", "\n", "<|endoftext|>", "12", "Ünïted", "!!'s", "ing", "中文", "\x1c", "ß", "İ"]), max_size=40).map("".join)
PLAIN = st.lists(st.sampled_from(["a", "b", "Ab", "é", "cc", " ", "\t", "\n", "\x0b"]), max_size=120).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_bpe_is_the_library(texts):
    for text, (ids, decoded) in zip(texts, BPE.encode(texts)):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == LIBRARY.decode(want, skip_special_tokens=False) == BPE.decode(want)


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(5, 60))
def test_slices_are_the_text(text, most):
    assert "".join(text_slices(text, most)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(PLAIN, max_size=6))
def test_shingles_are_those_of_words(texts):
    raw = [t.encode() for t in texts]
    got = {}
    for row, _, of, h in jaccard.shingles(raw, 4):
        for r, x in zip(of + row, h):
            got.setdefault(int(r), set()).add(int(x))
    keys = {}
    for i, t in enumerate(raw):
        words = t.lower().split()
        shingles = {tuple(words[a : a + 4]) for a in range(max(1, len(words) - 3))} if words else set()
        assert len(got.get(i, ())) == len(shingles)
        keys[i] = shingles
    for i in keys:
        for j in keys:
            assert len(keys[i] & keys[j]) == len(got.get(i, set()) & got.get(j, set()))


@settings(max_examples=100, deadline=None)
@given(st.lists(PLAIN, max_size=5))
def test_every_window_is_in_one_super_kmer(texts):
    level = np.zeros(1 << 20, np.uint8)
    raw = [t.encode() for t in texts]
    seen, windows = {}, {}
    for rows, mins, _, first, n in substrings.document_kmers(raw, 5, 2, level):
        for row, h, a, k in zip(rows, mins, first, n):
            for i in range(k):
                assert (row, a + i) not in seen
                seen[row, a + i] = h
    for row, t in enumerate(raw):
        words = t.split()
        for a in range(len(words) - 4):
            windows.setdefault(tuple(words[a : a + 5]), set()).add(seen.pop((row, a)))
    assert not seen and all(len(x) == 1 for x in windows.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_grams_keep_to_their_text(texts):
    whole = langid.features(texts)
    assert (whole == sum(langid.features([t]) for t in texts)).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<b>", "</b>", "<br>", "<!--", "-->", "<script>", "</script>", "<a href='>", "text", "&amp;", "&lt;p", "<", ">", "</", "<article>", "</article>", "<li>", "<td"]), max_size=40).map("".join))
def test_any_markup_is_read(page):
    runs, paths = blocks(page)
    assert all(text == " ".join(text.split()) and 0 <= linked <= len(text) for _, _, text, linked in runs) and all(x[2] > 0 for x in paths.values())
    assert isinstance(main_text(page), str)
