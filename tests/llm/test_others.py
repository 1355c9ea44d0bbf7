"""HTML extraction, vector search and the pipeline."""

import math

import pytest

from mnemolith.llm.html import extract_text, main_text
from mnemolith.llm.vafile import top_k


def page(title, body, extra=""):
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
    <div class="c1"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div><div class="c2"><h1>{title}</h1>{body}</div>
    <div class="c3">All rights reserved by the owner</div>{extra}</body></html>"""


def test_template_of_plain_containers(spark):
    texts = [f"Text number {i} caf&eacute; &amp; <b>bo</b>ld<br>line " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    rows = [(i, f"https://h.example.com/{i}", page(f"T{i}", f"<p>{t}<p>Second {i}", '<section id="comments"><p>Me too ' + "very " * 80 + "</p></section>")) for i, t in enumerate(texts)]
    rows += [(90, None, None), (91, "nonsense", ""), (92, "https://h.example.com/92", "plain text only"), rows[0]]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and got[90] == got[91] == ""
    assert got[92] == "plain text only"
    for i in range(12):
        assert got[i] == f"T{i} Text number {i} café & bold line " + " ".join(f"w{i}x{j}" for j in range(30)) + f" Second {i}"


def test_article_parts():
    html = """<body><header>Site</header><nav>menu</nav><article><header><h1>Head</h1></header><p>One &lt;two&gt;<div class="ad-box">buy</div><p>Three
      four<aside>side</aside><form>Name <input></form><div class="cookie-notice">ok?</div><ul><li>a<li>b</ul><footer>by</footer></article>
      <div class="comments"><article class="comment">I agree</article></div><footer>end</footer>"""
    assert main_text(html) == "Head One <two> Three four a b"
    assert main_text("") == "" and main_text("<p>unclosed <b>bold") == "unclosed bold"
    assert main_text("<div " * 3000 + "x") is not None


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_top_k(spark, scale):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * scale for _ in range(6)]) for i in range(400)]
    rows += [(i, rows[5][1]) for i in range(400, 430)]  # ties
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [math.nan] * 6), (503, [math.inf] * 6), (None, [0.1] * 6), (504, [0.5, 0.5])]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and i not in (500, 501, 502, 503)}
    asked = [i for i in whole if i % 20 == 0]
    out = top_k(df, df.where("vec_id % 20 = 0"), k=20).collect()
    for q in asked:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:20]
        assert [(r.rank, -r.score, r.vec_id) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == [(k + 1, s, i) for k, (s, i) in enumerate(best)]
    assert {r.query_id for r in out} == set(asked) and top_k(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns and 0 < now.count() <= 3 * before.count()
        now = now.cache()
    assert now.where("n_tokens > 0").count() == now.count()


def test_pipeline_near_duplicates(spark):
    """The stage against brute force, with pairs from 0.7 to 0.95 that each differ in a last run of words."""
    import corpus_pipeline

    def fives(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, kept, near = [], set(), 0
    for k, edits in enumerate([5, 8, 10, 12, 18, 19, 20, 21, 22, 23, 24, 30, 35] * 3):
        a = [f"w{k}x{j}" for j in range(200)]
        b = a[: 200 - edits] + [f"v{k}x{j}" for j in range(edits)]
        texts = " ".join(a), " ".join(b)
        x, y = map(fives, texts)
        same = 10 * len(x & y) >= 8 * len(x | y)
        near += same and len(x & y) < 0.82 * len(x | y)
        rows += [(2 * k + i, t, "en", "s1", len(t)) for i, t in enumerate(texts)]
        kept |= {2 * k} if same else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert near >= 3 and {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == kept


def test_pipeline_lines(spark):
    """Of twelve exact copies, one stays whole; a line of ten documents stays in the first of them, whose other lines all stay."""
    import corpus_pipeline

    copy = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    texts = [f"own {i}\n{'Menu' if i % 2 else ' menu '}\nmore {i}\nmenu" for i in range(10)] + [copy] * 12
    rows = [(40 - i, t, "en", "s1", len(t)) for i, t in enumerate(texts)] + [(None, copy, "en", "s1", len(copy)), (60, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows + rows[-3:-2], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.lines(spark, docs, "")
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    want = {(40 - i, f"own {i}\nmore {i}", len(f"own {i}\nmore {i}")) for i in range(9)} | {(31, "own 9\nMenu\nmore 9", 17), (None, copy, len(copy))}
    assert {x for x in got if x[1]} == want and {x for x in got if not x[1]} == {(60, "", 0)}
    # without the null id, the copy of the least id is the first
    some = corpus_pipeline.lines(spark, docs.where("doc_id < 31"), "").collect()
    assert [(r.doc_id, r.text) for r in some] == [(19, copy)] * 2
