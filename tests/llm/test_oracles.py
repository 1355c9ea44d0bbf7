"""The corpus queries against their SQL, on the smallest supplied tables, and the columns that each must return."""

from pathlib import Path

import pytest

from mnemolith.llm import queries

from tests import oracle

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")
COLUMNS = {
    "op1_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_lines": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op7_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_licenses": {"doc_id": "bigint", "license": "string", "containment": "double", "first_word": "bigint"},
    "op9_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", queries.ORACLE)
def test_same_rows(spark, con, name):
    assert oracle.differences(queries.QUERIES[name](spark, str(DATA)), con, queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns(spark, name):
    out = queries.QUERIES[name](spark, str(DATA))
    assert dict(out.dtypes) == COLUMNS[name]


def test_digests(spark, con):
    """The digests of op4 are those of the library's tokens and of its text."""
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.word_vocabulary())
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, str(DATA)).collect()}
    for doc_id, text in con.sql("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert out[doc_id] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
