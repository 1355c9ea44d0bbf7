"""Small scenarios with known results."""

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemolith.functions import text as fx
from mnemolith.operators import bundle, chunking, content, evaluate, fusion, lexical, lifecycle, mapreduce, session, summary, vector
from mnemolith.sources import files
from mnemolith.streaming import sessions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_bm25_prefers_more_and_shorter(spark):
    docs = spark.createDataFrame([(1, "apple apple apple pie now"), (2, "apple pie now"), (3, "other text here"), (4, "more of it"), (5, "and still more"), (6, "end"), (7, None)], "id long, text string")
    out = lexical.bm25(docs, spark.createDataFrame([(1, "Apple?")], "query_id long, query string"), ["id"]).orderBy("rank").collect()
    assert [r.id for r in out] == [1, 2] and out[1].score > 0


def test_bm25_is_that_of_the_index(spark, tmp_path):
    texts = ["the cats are running fast", "a cat ran", "running runners run", "dogs and cats", "nothing here at all", "relational databases relate"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts, 1)))
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    index = lexical.Index.build(docs, ["id"], str(tmp_path / "stems"), stem=True)
    for q in ("cats", "running cats", "relational", "fast dogs"):
        want = {i: round(-r, 6) for i, r in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (" OR ".join(q.split()),))}
        got = {r.id: r.score for r in lexical.Index(spark, index.path).search(spark.createDataFrame([(1, q)], "query_id long, query string"), ["id"]).collect()}
        assert got == pytest.approx(want, abs=2e-6)


def test_porter_as_the_index_stems():
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer operator feudalism decisiveness hopefulness formaliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words, 1)))
    want = dict(con.execute("SELECT doc, term FROM v"))
    assert {i: lexical.porter(w) for i, w in enumerate(words, 1)} == want


def test_ensemble_takes_champions_first(spark):
    ranks = spark.createDataFrame([("bm25", 1, "l", 1, 9.0), ("bm25", 1, "n", 2, 8.0), ("vector", 1, "s", 1, 0.9), ("vector", 1, "n", 2, 0.8)], "stream string, query_id long, id string, rank int, score double")
    fused = spark.createDataFrame([(1, "n", 0.9), (1, "l", 0.3), (1, "s", 0.2)], "query_id long, id string, fused double")
    assert [r.id for r in fusion.ensemble(fused, ranks, 3).orderBy("rank").collect()] == ["l", "s", "n"]
    both = fusion.rrf(ranks, {"bm25": 1, "vector": 1}).where("id = 'n'").first()
    assert set(both.contributions) == {"bm25", "vector"} and both.fused == round(1 / 62, 8)
    only = fusion.rrf(ranks.where("stream = 'bm25'"), {"bm25": 0.5, "vector": 0.5}, active_only=True).where("id = 'l'").first()
    assert only.fused == round(1 / 61, 8)
    with pytest.raises(ValueError):
        fusion.rrf(ranks, {"bm25": 0})


def test_vector_search_and_cache(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.6, 0.8, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vector.cosine_topk(df, asked).orderBy("rank").collect()] == [(1, 1.0), (2, 0.6)]
    items = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    none = spark.createDataFrame([], "model string, content_hash string, embedding array<float>")
    new, counts = vector.encode_missing(items, none, lambda texts: [[len(t), 0.5] for t in texts], "m", 2)
    assert new.count() == 2 and tuple(counts.first()) == (2, 2, 0)
    assert tuple(vector.encode_missing(items, new, lambda texts: [[0, 0]] * len(texts), "m", 2)[1].first()) == (2, 0, 2)


def test_content_store(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: r.is_new for r in content.dedup_flags(docs).collect()} == {1: True, 2: False, 3: True}
    store = content.content_store(docs)
    gone = docs.where("doc_id in (1, 3)").select(fx.content_hash("text").alias("content_hash"), F.lit(1).alias("n"))
    left = content.release(store, gone).collect()
    assert [(r.first_id, r.reference_count) for r in left] == [(1, 1)]


def test_ingest_again_is_nothing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# hello")
    (tmp_path / "y.markdown").write_text("text")
    (tmp_path / "AGENTS.md").write_text("skip")
    (tmp_path / "tiny.md").write_text("x")
    (tmp_path / "z.txt").write_text("no")
    found = files.discover_markdown(spark, str(tmp_path), min_bytes=3)
    assert {r.path.rsplit("/", 1)[1]: r.skipped for r in found.collect()} == {"x.md": None, "y.markdown": None, "AGENTS.md": "name", "tiny.md": "small"}
    kept = found.where("skipped is null").select("path", "sha256")
    assert files.ingest_plan(kept, kept).count() == 0
    assert files.ingest_plan(kept, kept.withColumn("sha256", F.lit("old"))).count() == 2
    assert {r.content for r in files.read_documents(spark, str(tmp_path / "a")).collect()} == {"# hello"}


def test_buffers_differ_by_configuration(spark):
    cols = "agent_id string, content_hash string, content_type string, strategy string, chunk_size int, overlap int"
    old = spark.createDataFrame([("a", "h", "docs", "s", 1000, 100, "b1", 1), ("a", "h", "docs", "s", 1000, 100, "b2", 2)], cols + ", buffer_id string, created_at int")
    new = spark.createDataFrame([("a", "h", "docs", "s", 1000, 100), ("a", "h", "docs", "s", 2000, 100)], cols)
    assert {(r.chunk_size, r.existing_id) for r in content.existing_buffers(new, old).collect()} == {(1000, "b2"), (2000, None)}


def test_chunks(spark):
    text = "\n\n".join("Sentence one. " * (5 + i % 60) for i in range(40)) + "é" * 2500
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    for overlap in (0, 100):
        c = chunking.chunk_documents(docs, size=1000, overlap=overlap)
        rows = c.where("doc_id = 1").orderBy("chunk_index").collect()
        assert all(r.content == text[r.char_start : r.char_end] and r.content.encode() == text.encode()[r.byte_start : r.byte_end] for r in rows)
        assert all(r.start_line == 1 + text[: r.char_start].count("\n") for r in rows) and rows[-1].char_end == len(text)
        assert {r.doc_id: r.lossless for r in chunking.lossless(c, docs).collect()} == {1: True, 2: True, 3: True, 4: True}
    assert "".join(r.content for r in chunking.chunk_documents(docs, overlap=0).where("doc_id = 1").orderBy("chunk_index").collect()) == text
    assert chunking.batches(c, ["doc_id"], ["chunk_index"]).select("batch_index").distinct().count() == 1


def tool_parts(spark, rows):
    return spark.createDataFrame(rows, "session_id long, position long, part_index int, role string, part_type string, tool_state string, is_protected boolean, compacted boolean, is_summary boolean, tokens long")


def test_tool_pruning(spark):
    rows = [(1, 1, 0, "user", "text", None, False, False, False, 5), (1, 2, 0, "assistant", "text", None, False, False, False, 5), (1, 2, 1, "assistant", "tool", "completed", False, False, False, 50), (1, 3, 0, "user", "text", None, False, False, False, 5), (1, 3, 1, "user", "tool", "running", False, False, False, 90)]
    cut = session.prune_tools(tool_parts(spark, rows), 0, 1, 1).collect()
    assert [(r.position, r.part_index) for r in cut] == [(2, 1)]
    safe = [(*r[:6], r[4] == "tool", *r[7:]) for r in rows]
    assert session.prune_tools(tool_parts(spark, safe), 0, 1, 1).count() == 0
    assert session.prune_tools(tool_parts(spark, rows), 0, 50, 1).count() == 0
    closed = [*rows, (1, 2, 2, "assistant", "tool", "completed", False, True, False, 5)]
    assert session.prune_tools(tool_parts(spark, closed), 0, 1, 1).count() == 0
    summed = [*rows, (1, 2, 3, "assistant", "text", None, False, False, True, 1)]
    assert session.prune_tools(tool_parts(spark, summed), 0, 1, 1).count() == 0


def messages(spark, texts, roles=None):
    rows = [(1, i, i + 1, (roles or ["user", "assistant"] * len(texts))[i], t, max(1, len(t) // 4) if t else 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session_id long, turn long, position long, role string, text string, tokens long")


def test_compaction_shrinks(spark):
    m = messages(spark, [f"fact {i} file_abc{i:03d} " + "long text " * 200 for i in range(8)], ["user"] * 8)
    view = m.select("session_id", "position", F.lit("message").alias("item_type"), F.col("turn").cast("string").alias("item_id"), "role", "text", "tokens", F.lit(-1).cast("long").alias("level"), F.col("turn").cast("string").alias("span_start"), F.col("turn").cast("string").alias("span_end"))
    out = summary.compact_context(view, session.Budget(2000, 0, 0))[2].first()
    assert out.rounds == 1 and out.after < out.before and out.effective
    s = summary.compact(m).first()
    assert s.shrinks and s.covered == 8 and s.content.startswith("[L3 DETERMINISTIC COMPACTION — 8 messages]") and len(s.file_ids) == 8 and "file_abc007" in s.content
    assert summary.compact_context(view, session.Budget(10**6, 0, 0))[2].first().rounds == 0
    assert summary.compact_context(view, session.Budget(10**6, 0, 0), force=True)[2].first().rounds == 1
    assert summary.compact_context(view, session.Budget(5000, 0, 0), defer_soft=True)[2].first().deferred
    assert not summary.compact(messages(spark, ["a", "b", "c"])).first().shrinks


def test_soft_overflow(spark):
    stats = session.session_stats(messages(spark, ["x" * 2600]))
    b = session.Budget(1200, 150, 50)
    assert (b.hard, b.soft) == (1000, 600)
    assert session.compaction_due(stats, b).first().reason == "soft_overflow" and session.compaction_due(stats, b, hard_only=True).count() == 0
    assert (session.Budget().hard, session.Budget().soft) == (194_000, 116_400)


def test_budget_is_kept(spark):
    m = messages(spark, ["a" * 4000, "b" * 400, "c" * 80])
    assert [r.turn for r in session.budget_tail(m, 150).orderBy("turn").collect()] == [1, 2]
    big = session.budget_tail(messages(spark, ["b" * 80, "a" * 4000]), 150).collect()
    assert [(r.turn, r.is_cut) for r in big] == [(1, True)]
    cut = one(spark, session.fit_text(F.col("t"), F.lit("\n\n[cut]"), 20), t="word " * 100)
    assert cut.endswith("\n\n[cut]") and len(cut) // 4 <= 20
    assert one(spark, session.fit_text(F.col("t"), F.lit("x" * 100), 20), t="word") is None
    assert [tuple(r) for r in session.budget_prefix(m, 1100).orderBy("turn").select("turn", "room").collect()] == [(0, None), (1, 90)]


def test_candidates_keep_recent(spark):
    m = messages(spark, ["x"] * 6, ["user", "assistant", "user", "assistant", "assistant", "assistant"])
    assert sorted(r.turn for r in session.candidates(m, 2).collect()) == []
    m = messages(spark, ["x"] * 6, ["assistant", "assistant", "user", "assistant", "user", "assistant"])
    assert sorted(r.turn for r in session.candidates(m, 2).collect()) == [0, 1]
    assert session.candidates(m, 0).count() == 6
    m = messages(spark, ["x"] * 5, ["assistant"] * 5)
    assert sorted(r.turn for r in session.candidates(m, 2).collect()) == [0, 1, 2]


def test_coalesced_and_pending(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(minutes=i), k) for i, k in enumerate(["tool", "prompt", "tool", "stop", "prompt", "discard", "stop", "tool"])]
    rows += [(2, 20, t0, "prompt"), (2, 21, t0 + dt.timedelta(hours=30), "stop")]
    e = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, kind string")
    want = [(1, 3, 0, "tool", 1), (1, 3, 1, "prompt", 2), (1, 3, 2, "tool", 3), (1, 3, 3, "stop", 4), (1, 6, 6, "stop", 1), (2, 21, 21, "stop", 1)]
    assert sorted(map(tuple, sessions.committed_turns(e).collect())) == want
    assert [tuple(r) for r in sessions.expired_turns(e, t0 + dt.timedelta(days=3)).collect()] == [(1, 7)]
    same = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=i), k) for i, k in enumerate("aabba")], "session_id long, event_id long, ts timestamp, kind string")
    assert [(r.kind, r.n) for r in sessions.coalesced(same).orderBy("island").collect()] == [("a", 2), ("b", 2), ("a", 1)]


def test_stream_commits_as_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, 10 * s + i, t0 + dt.timedelta(minutes=i), k) for s in (1, 2, 3) for i, k in enumerate(["prompt", "tool", "stop", "prompt", "discard", "stop"])]
    e = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, kind string")
    for i, half in enumerate((e.where("event_id % 10 < 2"), e.where("event_id % 10 >= 2"))):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.stream_committed_turns(stream).writeStream.format("memory").queryName("committed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("committed").collect())) == sorted(map(tuple, sessions.committed_turns(e).collect()))


def test_ingest_stream_adds_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "k string, v string")
    docs.write.parquet(str(tmp_path / "in"))
    for i in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        q = sessions.ingest_batches(stream, str(tmp_path / "out"), ["k"]).option("checkpointLocation", str(tmp_path / f"cp{i}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_corrections_and_versions(spark):
    items = spark.createDataFrame([("w", "memory", "port is 80", "medium", None, None)], "item_id string, source_type string, text string, confidence string, valid_to long, superseded_by string")
    out = {r.source_type: r for r in lifecycle.correct(items, spark.createDataFrame([("w", "port is 81", 7)], "wrong_id string, statement string, at long")).collect()}
    assert out["correction"].confidence == "high" and out["memory"].confidence == "low" and out["memory"].superseded_by == out["correction"].item_id and out["memory"].valid_to == 7
    v = lifecycle.merge_key_versions(spark.createDataFrame([(1, "k", 1), (2, "k", 2)], "id long, key string, ver long"), ["key"], "ver", "id")
    assert {r.id: (r.superseded_by, r.supersedes) for r in v.collect()} == {1: (2, None), 2: (None, 1)}
    known = spark.createDataFrame([("a",)], "item_id string")
    claims = spark.createDataFrame([("c", "a"), ("c", "zz")], "claim_id string, item_id string")
    links = {r.item_id: r for r in lifecycle.contradict(known, claims).collect()}
    assert links["c"].contradicts == ["a"] and links["a"].contradicted_by == ["c"] and lifecycle.unknown_claims(known, claims).count() == 1


def test_active_recall_order(spark):
    cols = "item_id string, agent_id string, source_type string, confidence string, controller_ignored boolean, superseded_by string, supersedes string, indexed_at long"
    items = spark.createDataFrame([("stale", "g", "memory", "medium", False, "x", None, 3), ("ign", "g", "correction", "high", True, None, None, 2), ("cor", "g", "correction", "high", False, None, "stale", 1), ("plain", "g", "memory", "medium", False, None, None, 4)], cols)
    out = lifecycle.active_recall(items).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in out] == [("cor", 5.85), ("plain", 1.0)] and "correction" in out[0].reasons


def test_references(spark):
    t = "see file_deadbeef and file_DEADBEEF, rlm_chunk:a/b-1. message:m2/ file_xyz"
    assert one(spark, fx.file_ids("t"), t=t) == ["file_deadbeef", "file_DEADBEEF"] and one(spark, fx.source_refs("t"), t=t) == ["rlm_chunk:a/b-1", "message:m2"]
    foot = one(spark, fx.add_footers(F.col("t"), F.array(F.lit("file_aaaaaa")), F.array(F.lit("message:1"))), t="body\n[LCM File IDs: file_old000]")
    assert foot == "body\n\n[LCM File IDs: file_aaaaaa]\n\n[LCM Source Refs: message:1]" and one(spark, fx.strip_footers("t"), t=foot) == "body"
    lossless = lambda a, b: one(spark, summary.is_lossless(F.col("a"), F.col("b")), a=a, b=b)
    assert lossless(["f1"], ["f1", "f2"]) and not lossless(["f1", "f3"], ["f1"])
    assert one(spark, fx.is_file_id("t"), t="file_abcdef") and not one(spark, fx.is_file_id("t"), t="xfile_abcdef")


def test_text_functions(spark):
    assert one(spark, fx.preview("t", 10), t="  a  b\n" + "c" * 20) == "a b ccccc…"
    assert one(spark, fx.stemmed_query_words("t"), t="Running walked classes grass as") == ["running", "runn", "walked", "walk", "classes", "classe", "grass", "as"]
    assert one(spark, fx.answer_matches(F.lit("the 2nd"), F.col("t")), t="it was 2.") and not one(spark, fx.answer_matches(F.lit("22"), F.col("t")), t="it was 2")
    assert one(spark, fx.epoch_seconds("t"), t=1_700_000_000_000) == 1_700_000_000 and one(spark, fx.iso_utc("t"), t=0) == "1970-01-01T00:00:00Z"
    assert str(one(spark, fx.session_date("t"), t="2023/05/20 (Sat) 02:21")) == "2023-05-20 02:21:00" and str(one(spark, fx.session_date("t"), t="1:56 pm on 8 May, 2023")) == "2023-05-08 13:56:00"
    assert one(spark, fx.batch_index("t"), t="x\nBatch index: 12\n") == 12 and one(spark, fx.batch_index("t"), t="none") is None
    assert one(spark, fx.snippet(F.col("t"), F.lit(500), F.lit(510), 100), t="w" * 1000) == "…" + "w" * 100 + "…"
    assert one(spark, fx.occurrences(F.col("t"), F.lit("ab")), t="ABxabab") == 3 and one(spark, fx.clip("t", 3), t="﻿abcdef") == "abc ..."


def test_batches_and_runs(spark):
    text = "\n\n".join("Para %d. " % i + "word " * 150 for i in range(12))
    chunks = chunking.batches(chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")), ["doc_id"], ["chunk_index"], 3)
    res = mapreduce.run_batches(chunks)
    n = res.count()
    want = spark.createDataFrame([(1, n + 1)], "doc_id long, batches long")
    got = mapreduce.completeness(res.unionByName(res.where("batch_index = 0")), want).first()
    assert got.missing == [n] and got.duplicates == [0] and got.extra == []
    assert mapreduce.completeness(res, spark.createDataFrame([(1, 1)], "doc_id long, batches long")).first().extra == list(range(1, n))
    agg = mapreduce.aggregate(res).first()
    assert agg.batches == n and agg.text.startswith("Batch index: 0\n") and agg.chunk_ids == sorted(agg.chunk_ids)
    assert mapreduce.record(res, res).count() == n
    final = mapreduce.recurse(mapreduce.aggregate(res), lambda t: t[0][: len(t[0]) // 3], limit=max(10, agg.tokens // 2)).first()
    assert final.rounds == 1 and final.fits

    def broken(texts):
        raise RuntimeError("down")

    bad = mapreduce.run_batches(chunks, broken)
    assert {r.status for r in bad.collect()} == {"failed"} and mapreduce.run_metrics(bad, want.withColumnRenamed("batches", "expected")).first().coverage == 0


def test_percentiles_by_nearest_rank(spark):
    values = [5.0, 1.0, 4.0, 2.0]
    out = evaluate.latency(spark.createDataFrame([("g", v) for v in values], "k string, v double"), ["k"], "v").first()
    assert (out.p50, out.p95) == (sorted(values)[round(3 * 0.5)], sorted(values)[round(3 * 0.95)])


def test_evidence(spark):
    docs = spark.createDataFrame([(1, "x" * 37 + "the passage that is looked for here" + "y" * 50), (2, "none of it"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the passage that is looked for here"), (8, "absent passage of some length, really")], "item_id long, text string")
    assert [tuple(r) for r in evaluate.containing(docs, items).collect()] == [(7, 1, 37)]
    chunks = spark.createDataFrame([(1, 0, 0, 1500), (1, 1, 1400, 2600)], "doc_id long, chunk_index long, char_start long, char_end long")
    spans = spark.createDataFrame([(1, 5, 900, 1450), (1, 6, 2600, 2700)], "doc_id long, item_id long, start long, end long")
    assert sorted((r.chunk_index, r.item_id) for r in evaluate.overlapping(chunks, spans).collect()) == [(0, 5), (1, 5)]
    checks = spark.createDataFrame([("a", "x", True), ("a", "y", False), ("b", "z", True)], "dimension string, name string, ok boolean")
    assert {r.dimension: (r.passed, r.failed) for r in evaluate.coverage(checks).collect()} == {"a": (False, ["y"]), "b": (True, [])}


def test_bundle_policy(spark):
    hits = spark.createDataFrame([(1, i, 10 + i, "f" * 400, "c" * 200, "s" * 100, "p" * 40) for i in range(1, 6)], "query_id long, rank int, id long, full string, champion string, snippet string, preview string")
    for budget, policy in ((1000, "full"), (300, "champion"), (150, "snippet"), (70, "preview"), (30, "trimmed"), (2, "none")):
        assert bundle.choose_policy(hits, budget).first().policy == policy


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"session_id": "s1", "turns": [{"role": "USER", "content": "hi"}, {"role": "odd", "content": "x"}]}))
    assert [tuple(r) for r in files.session_files(spark, str(tmp_path / "s.json")).orderBy("turn").collect()] == [("s1", 0, "user", "hi"), ("s1", 1, "user", "x")]
    t = spark.createDataFrame([(1, "lost\n[user]: one\nmore\n[Assistant]: two")], "id long, t string")
    assert [tuple(r) for r in files.labelled_transcript(t, "id", "t").orderBy("turn").collect()] == [(1, 0, "user", "one\nmore"), (1, 1, "assistant", "two")]
    lines = spark.createDataFrame([(1, 1, '{"role":"assistant","content":"a"}'), (1, 2, '{"message":{"role":"assistant","content":"b"}}'), (1, 3, '{"role":"user","content":"c"}'), (1, 4, "bad")], "id long, n long, line string")
    assert [tuple(r) for r in files.last_assistant(lines, "id", "line", "n").collect()] == [(1, "b")]
    hook = files.parse_hooks(spark.createDataFrame([('{"hook_event_name":"UserPromptSubmit","sessionId":"q","prompt":"do"}',), ("plain words",)], "payload string")).collect()
    assert (hook[0].event, hook[0].session_id, hook[0].prompt) == ("user-prompt-submit", "q", "do") and hook[1].prompt == "plain words"
    tools = spark.createDataFrame([(1, '{"tool_name":"grep","output":"hit","id":"c1"}'), (2, '{"toolResults":[{"name":"a","result":"x"},{"name":"b"},{"tool":{"name":"c"},"stdout":"y","status":"failed"}]}'), (3, "{}"), (4, "no json"), (5, '{"tool_outputs":[{"name":"p","stdout":"o","stderr":"e"}],"toolCalls":{"name":"q","arguments":"args"},"name":"r","result":"z"}')], "id long, payload string")
    assert sorted((r.id, r.place, r.tool_name, r.tool_state, r.content) for r in files.tool_turns(tools, "id").collect()) == [(1, 0, "grep", "completed", "hit"), (2, 0, "a", "completed", "x"), (2, 2, "c", "failed", "y"), (5, 0, "p", "completed", "o\ne"), (5, 1, "q", "completed", "args"), (5, 2, "r", "completed", "z")]
    listing = spark.createDataFrame([("docs/a.md",)], "path string")
    asks = spark.createDataFrame([(1, "read `docs/a.md`, then docs/a.md and b.md")], "id long, t string")
    assert [tuple(r) for r in files.prompt_files(asks, listing, "id", "t").collect()] == [(1, "docs/a.md", 1)]


def test_benchmark_sources(spark):
    sample = {"sample_id": "p", "conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hey"}], "session_1_date_time": "1:56 pm on 8 May, 2023"}, "qa": [{"question": "q", "answer": "a", "category": 2, "evidence": ["D1:1"]}]}
    df = spark.createDataFrame([(json.dumps(sample),)], "json string")
    turn = files.locomo_turns(df).first()
    assert (turn.sample_id, turn.session_no, str(turn.date), turn.dia_id) == ("p", 1, "2023-05-08 13:56:00", "D1:1")
    assert files.locomo_questions(df).first().evidence == ["D1:1"]
    cases = spark.createDataFrame([("q1", ["s1"], ["2023/05/20 (Sat) 02:21"], [[("user", "hi", None), ("assistant", "yo", True)]])], "question_id string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role string, content string, has_answer boolean>>>")
    rows = files.longmemeval_turns(cases).orderBy("turn").collect()
    assert [(r.session_id, r.turn, r.role, r.has_answer) for r in rows] == [("s1", 0, "user", False), ("s1", 1, "assistant", True)]
    spans = files.flatten_case(files.longmemeval_turns(cases), "question_id", ("session_no", "turn"), "content").orderBy("turn").collect()
    assert [(r.char_start, r.char_end) for r in spans] == [(0, 2), (3, 5)]
    assert files.stress_turns(spark, 3, 4).count() == 12


def test_upserts(spark):
    cols = "session_id long, system_prompt string, model_id string, agent string, updated_at long"
    old = spark.createDataFrame([(1, "p", "m", "a", 1)], cols)
    new = spark.createDataFrame([(1, "", "n", "b", 2), (2, "q", "", "c", 2)], cols)
    out = {r.session_id: (r.system_prompt, r.model_id, r.agent, r.updated_at) for r in content.upsert_sessions(old, new).collect()}
    assert out == {1: ("p", "n", "b", 2), 2: ("q", None, "c", 2)}
    parts = spark.createDataFrame([(1, None), (2, 5), (3, None)], "part_id long, compacted_at long")
    assert {r.part_id: r.compacted_at for r in content.mark_compacted(parts, parts.where("part_id < 3").select("part_id"), F.lit(9)).collect()} == {1: 9, 2: 5, 3: None}
    items = spark.createDataFrame([(1, {"a": "1"})], "item_id long, metadata map<string,string>")
    ups = spark.createDataFrame([(1, {"a": "2", "b": "3"})], "item_id long, metadata map<string,string>")
    assert content.merge_metadata(items, ups).first().metadata == {"a": "2", "b": "3"}


def test_references_after_long_text(spark, tmp_path):
    from mnemolith.plans import registry

    late = "x" * 120_000 + " file_abc123 source message:m77 "
    assert one(spark, fx.file_ids("t"), t=late) == ["file_abc123"]
    spark.createDataFrame([(1, late)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = registry.file_ids_extract(spark, str(tmp_path)).first().ids.split(",")
    assert ids[0] == "file_abc123" and len(ids) == 3 and ids[2] == "file_abcdef"
    assert registry.source_refs_extract(spark, str(tmp_path)).first().refs == "message:m77,rlm_chunk:1/a.b,message:m1"


def test_more_than_a_million_positive(spark):
    n = 1_000_010
    v = F.when(F.col("id") == n - 1, F.array(F.lit(0.1), F.lit(1.0))).when(F.col("id") == n - 2, F.array(F.lit(-1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    rows = spark.range(n).select(F.col("id").alias("vec_id"), v.alias("embedding"))
    out = vector.cosine_hits(rows, rows.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")).collect()
    assert sorted(r.query_id for r in out) == [0, 1, 2, 3, 4] and {(r.hits, round(r.least, 6)) for r in out} == {(n - 1, 0.099504)}


def test_failures_of_an_analyser(spark):
    """Transient failures are tried again, others are rows; equal inputs are analysed once."""
    tries = []

    def odd(texts):
        tries.append(1)
        if "never" in texts[0]:
            raise ValueError("no")
        if "late" in texts[0] and len(tries) < 3:
            raise mapreduce.TransientError("later")
        return texts[0].upper()

    assert mapreduce.attempt(odd, ["late"], 2) == ("LATE", 1, "ok", None, None, None, 2)
    assert mapreduce.attempt(odd, ["never"], 5)[2:] == ("failed", "ValueError: no", "ValueError", False, 0)
    tries.clear()
    assert mapreduce.attempt(odd, ["late"], 0)[5:] == (True, 0)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "never")], "id long, input string")
    known = spark.createDataFrame([("b", "old")], "input string, output string").select(fx.content_hash("input").alias("input_hash"), "output")
    out = {r.id: (r.output, r.status, r.cached) for r in mapreduce.analyse_once(rows, odd, known).collect()}
    assert out == {1: ("A", "ok", False), 2: ("A", "ok", False), 3: ("old", "ok", True), 4: (None, "failed", False)}
    big = spark.createDataFrame([(1, 2, [0, 1], "x" * 400, 100)], "doc_id long, batches long, chunk_ids array<bigint>, text string, tokens long")
    final = mapreduce.recurse(big, lambda t: t[0], limit=50, rounds=2)
    assert mapreduce.refused(final, 50).count() == 1 and final.first().rounds == 2


def test_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, "xabcdefghijklmnopqrstuvwxyz0123456789"), (2, "a"), (3, None), (4, "zz\u00e9z")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "bc"), (3, "cdefg"), (4, "efghijklmn"), (5, "fghijklmnopqrstuvwxy"), (6, "bcdefghijklmnopqrstuvwxyz0123456789"), (7, ""), (8, None), (9, "\u00e9"), (10, "nowhere")], "item_id long, text string")
    out = sorted(map(tuple, evaluate.containing(docs, asked).collect()))
    assert out == [(1, 1, 1), (1, 2, 0), (2, 1, 2), (3, 1, 3), (4, 1, 5), (5, 1, 6), (6, 1, 2), (9, 4, 2)]
    assert evaluate.containing(docs, asked.limit(0)).count() == 0


def test_bundles_for_models_and_audits(spark):
    rows = spark.createDataFrame([(1, 1, "system", "system", "system", "be brief", 2, False), (1, 2, "message", "m1", "user", "hi", 1, True)], "session_id long, place long, source string, source_id string, role string, text string, tokens long, is_cut boolean")
    assert json.loads(bundle.model_payload(rows).first().payload) == {"messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hi"}]}
    audit = bundle.audit_payload(rows, 100)
    assert audit.first().asDict() == {"session_id": 1, "token_estimate": 8, "budget": 100, "messages": 1, "summaries": 0, "truncated": True, "raw_refs": ["system:system", "message:m1"]}
    assert json.loads(bundle.snapshot_events(audit).first().detail) == {"budget": 100, "messages": 1, "summaries": 0, "token_estimate": 8, "truncated": True}
    with pytest.raises(ValueError):
        bundle.guarded(rows)
    assert bundle.guarded(rows.select("session_id", "role", "text")).count() == 2


class Loud:
    def complete(self, system, user, max_tokens, temperature):
        return f"{system}:{user.upper()[:max_tokens]}"


def test_providers_and_commands(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, "cd")], "id long, input string")
    assert {r.id: r.output for r in mapreduce.completions(rows, Loud(), "s", 1).collect()} == {1: "s:A", 2: "s:C"}
    assert mapreduce.CommandRunner(["tr", "a-z", "A-Z"])(["ab", "c"]) == "AB\x0cC"
    assert mapreduce.attempt(mapreduce.CommandRunner(["sleep", "5"], 0.1), ["x"], 1)[3:] == (mapreduce.attempt(mapreduce.CommandRunner(["sleep", "5"], 0.1), ["x"], 1)[3], "TransientError", True, 1)
    assert mapreduce.attempt(mapreduce.CommandRunner(["false"]), ["x"], 1)[5:] == (False, 0)
    place = tmp_path / "pending.json"
    files.write_whole(rows, str(place))
    files.write_whole(rows.where("id = 2"), str(place))
    assert [json.loads(x) for x in place.read_text().splitlines()] == [{"id": 2, "input": "cd"}] and not (tmp_path / "pending.json.part").exists()


def test_hashed_encoder(spark):
    texts = ["The caf\u00e9, the cat", "a cat", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    native = {r.doc_id: r.embedding for r in vector.hashed_vectors(df, dimensions=8).collect()}
    own = vector.hashed_encoder(8)(texts)
    assert native[2] is native[3] is None and not own[2:].any()
    assert native[0] == pytest.approx(own[0].tolist(), abs=1e-6) and native[1] == pytest.approx(own[1].tolist(), abs=1e-6)
