"""Contexts with so little room left that of a cut message only the note stays, against their SQL."""

import duckdb
import pytest

from mnemolith.plans import registry, sources  # noqa: F401

from . import oracle


@pytest.fixture(scope="module")
def tight(spark, tmp_path_factory):
    """Sessions whose first summaries leave every number of tokens from all to none; ids of three and of five digits."""
    d = str(tmp_path_factory.mktemp("tight"))
    rows = [(i + k, turn, role, text) for i in (100, 10100) for k in range(140) for turn, role, text in ((0, "user", "a" * 4 * k), (1, "assistant", "b"), (2, "user", "word " * 200))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
    return d, con


def test_context_build_note_alone(spark, tight):
    d, con = tight
    assert oracle.differences(registry.QUERIES["context_build"](spark, d), con, registry.ORACLES["context_build"]) is None


def test_audit_payload_note_alone(spark, tight):
    d, con = tight
    assert oracle.differences(registry.QUERIES["audit_payload"](spark, d), con, registry.ORACLES["audit_payload"]) is None


def test_context_snapshot_note_alone(spark, tight):
    d, con = tight
    assert oracle.differences(registry.QUERIES["context_snapshot"](spark, d), con, registry.ORACLES["context_snapshot"]) is None
