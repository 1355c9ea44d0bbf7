"""The disk that a stored memory takes, its index in segments, and its logs with repeated keys."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemolith import memory
from mnemolith.operators import lexical
from mnemolith.plans import facade, registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Conversations and documents of words that repeat rarely within a text."""
    d, draw = str(tmp_path_factory.mktemp("tables")), random.Random(1)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(5000)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    spark.createDataFrame([(i, t, "user" if t % 2 else "assistant", text(60)) for i in range(100) for t in range(4)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, text(400)) for i in range(1000)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def size(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*.parquet"))


@pytest.mark.parametrize("name", ["memory_recall", "memory_context", "memory_messages", "memory_search", "memory_buffers", "memory_chunks", "memory_counts", "memory_dispatch", "memory_items", "memory_sessions"])
def test_memory_within_four_times_its_input(spark, tables, name):
    registry.QUERIES[name](spark, tables).collect()
    assert size(facade.memory(spark, tables).root) <= 4 * size(tables)


def test_segments_are_the_postings(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_TEXTS", 3)
    monkeypatch.setattr(lexical, "SEGMENT_WORDS", 8)
    texts = [("a", "x y x"), ("b", ""), ("a", "x y x"), ("c", "y"), ("d", "z " * 20), ("e", "x z"), ("f", ""), ("g", "y y y")]
    docs = spark.createDataFrame(texts, "version string, text string").coalesce(1)
    rows = lexical.segments(docs.select("version", F.split(F.trim("text"), " ").alias("terms")).withColumn("terms", F.filter("terms", lambda w: w != ""))).cache()
    lists = rows.where("term is null").select("segment", F.posexplode(F.arrays_zip("versions", "lens")).alias("place", "d")).select("segment", "place", "d.versions", "d.lens")
    words = rows.where("term is not null").select("segment", "term", F.explode(F.arrays_zip("places", "tfs")).alias("p")).select("segment", "term", F.col("p.places").alias("place"), "p.tfs")
    got = {tuple(r) for r in words.join(lists, ["segment", "place"]).select("versions", "lens", "term", "tfs").collect()}
    assert got == {(v, len(t.split()), w, t.split().count(w)) for v, t in texts for w in t.split()}
    assert {(r.versions, r.lens) for r in lists.collect()} == {(v, len(t.split())) for v, t in texts} and lists.select("segment").distinct().count() > 2


def test_last_row_of_repeated_keys(spark, tmp_path, monkeypatch):
    m = memory.Memory(spark, str(tmp_path / "m"))
    for rows in ([("a", 0, 1), ("b", 0, 1), (None, 0, 1)], [("a", 0, 2), (None, 0, 2)]):
        m.write("context", spark.createDataFrame(rows, "session_id string, item_id long, position long").withColumns({"item_type": F.lit("message"), "gone": F.lit(False)}))
    for most in (100, 0):
        monkeypatch.setattr(memory, "FEW_KEYS", most)
        assert {(r.session_id, r.position) for r in m.table("context").collect()} == {("a", 2), ("b", 1), (None, 2)} and m.table("context").count() == 3


def test_rounds_post_each_text_once(spark, tmp_path):
    texts = spark.createDataFrame([(f"x y{i % 7} z{i}",) for i in range(40)], "text string")
    found = []
    for rounds in (1, 3):
        m = memory.Memory(spark, str(tmp_path / f"m{rounds}"))
        m.post(texts, rounds)
        lists = m.log("postings").where("term is null")
        versions = [r.v for r in lists.select(F.explode("versions").alias("v")).collect()]
        asked = spark.createDataFrame([(1, "y3 z3"), (2, "x")], "query_id long, query string")
        best = m.bm25(texts.withColumn("doc_id", F.col("text")), asked).collect()
        found.append((sorted(versions), {(r.query_id, r.doc_id, round(r.score, 9)) for r in best}))
        assert lists.select("batch").distinct().count() == rounds
    assert found[0] == found[1] and len(found[0][0]) == 40
