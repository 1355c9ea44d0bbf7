"""What the near-duplicate stage of the pipeline shuffles, and its rows by each of its ways."""

import re

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def rows():
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    near = text(1) + " more"
    return [(1, text(1)), (2, near), (3, text(1)), (4, text(4)), (5, None), (6, ""), (None, text(7)), (None, text(1)), (8, text(8)), (8, text(9)), (10, text(9)), (8, near)]


def of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shown(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("gone, keys", [(1000, 1000), (1000, 0), (0, 1000)])
def test_rows(spark, rows, monkeypatch, gone, keys):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", gone)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_KEYS", keys)
    # 2, 3 and one row of 8 are near 1, and 10 equals another row of 8, whose own component is its id
    want = [r for r in rows if r[0] not in (2, 3, 10)]
    assert shown(corpus_pipeline.near_duplicates(spark, of(spark, rows), "")) == sorted(map(repr, want))
    repeated = rows + [rows[0], rows[3], rows[4], rows[7], rows[8], rows[1]]
    assert shown(corpus_pipeline.near_duplicates(spark, of(spark, repeated), "")) == sorted(map(repr, want))


def moved(df):
    """The exchanges of whole rows in a plan, but for broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange (?:hash|range|Round)\w*\([^\n]*", plan)]


def test_texts_stay_where_they_are(spark, rows):
    assert moved(corpus_pipeline.near_duplicates(spark, of(spark, rows), "")) == []


def test_one_shuffle_of_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 0)
    out = corpus_pipeline.near_duplicates(spark, of(spark, rows), "")
    assert len(moved(out)) == 2  # of texts and of the ids that go
