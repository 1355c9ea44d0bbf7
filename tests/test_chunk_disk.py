"""The disk that an index of chunks takes while it is written, and its rows on repeated and null keys."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import lexical
from mnemolith.plans import registry
from mnemolith.sources import tables as src


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of words that repeat rarely within a chunk."""
    d, draw = str(tmp_path_factory.mktemp("tables")), random.Random(2)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(3, 9))) for _ in range(5000)]
    spark.createDataFrame([(i, " ".join(draw.choices(words, k=600))) for i in range(1500)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def size(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*.parquet"))


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, getattr(sc.statusStore(), "stageList$default$4")(), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_chunk_search_within_twice_its_input(spark, tables):
    shared, before = src.shared_folder(spark), shuffled(spark)
    old = size(shared)
    registry.QUERIES["chunk_search"](spark, tables).collect()
    assert size(shared) - old + shuffled(spark) - before <= 2 * size(tables)


@pytest.mark.parametrize("stem", [False, True])
def test_index_on_repeated_and_null_keys(spark, tmp_path, monkeypatch, stem):
    monkeypatch.setattr(lexical, "SEGMENT_TEXTS", 3)
    monkeypatch.setattr(lexical, "SEGMENT_WORDS", 8)
    rows = [(1, 0, "x y x"), (1, 0, "y z y"), (1, 0, "x"), (1, 1, None), (None, 2, "x y"), (None, 2, "x q"), (3, None, ""), (4, 4, "z " * 20), (5, 0, "q y"), (5, 0, "q y"), (6, 1, "w w y"), (7, 1, "v"), (8, 1, "u t s")]
    docs = spark.createDataFrame(rows, "a long, b int, text string").coalesce(2)
    asked = spark.createDataFrame([(1, "x z"), (2, "y"), (3, "Q w nowhere"), (4, "nowhere"), (5, "")], "query_id long, query string")
    index = lexical.Index.build(docs, ["a", "b"], str(tmp_path / "i"), stem=stem)
    got = {tuple(r) for r in index.search(asked, ["a", "b"], None).select("query_id", "a", "b", "score", "rank").collect()}
    assert got == {tuple(r) for r in lexical.bm25(docs, asked, ["a", "b"], None).select("query_id", "a", "b", "score", "rank").collect()} and len(got) == 10


def test_index_of_no_documents(spark, tmp_path):
    index = lexical.Index.build(spark.createDataFrame([], "id string, text string"), ["id"], str(tmp_path / "i"))
    assert index.search(spark.createDataFrame([(1, "x")], "query_id long, query string"), ["id"]).count() == 0
