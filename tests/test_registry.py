"""Every registered query against its SQL, on the smallest supplied tables."""

from pathlib import Path

import pytest

from mnemolith.plans import registry

from . import oracle

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_same_rows(spark, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, str(DATA)), con, registry.ORACLES[name]) is None


def test_without_sql(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
