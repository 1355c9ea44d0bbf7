"""Small corpora with the hard cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["The", "of", "é", "Éa"] * 30
    out = []
    for i in range(160):
        text = "\n".join(prose(rng, rng.randint(1, 40), words) for _ in range(rng.randint(1, 6)))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(text)))
    passage = prose(rng, 60, words)
    for i in range(160, 175):
        out.append((i, f"{prose(rng, 30, words)}\n  A common Line \n{passage} {prose(rng, 30, words)}", "en", "s1", 0))
    base = prose(rng, 120, words).split()
    for i in range(175, 200):  # near copies
        copy = list(base)
        copy[rng.randrange(120)] = f"edit{i}"
        out.append((i, " ".join(copy), "en", "s1", 0))
    out += [(200 + i, out[0][1], "en", "s2", 0) for i in range(12)]  # exact copies
    out += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", "s1", 4), (303, "word", "en", "s9", 4), (304, "word " * 3000, "en", "s1", 0), (305, "x" * 50_000, "en", "s1", 0)]
    out += [(306, prose(rng, 30_000, words), "en", "s2", 0)]
    return out + [out[3], out[3]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns that have names of results."""
    from pyspark.sql import functions as F

    names = ["size", "target", "kept", "h", "n", "id", "ids", "label", "rank", "score", "key", "n_words", "decoded", "component_id", "_row", "_id"]
    return docs.withColumns({n: F.lit("x") for n in names})
