"""Every registered vault query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from oracle import connect, difference

from notelake.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert difference(df, ORACLES[name], con) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item", "project", "priority", "p"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
