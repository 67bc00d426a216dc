"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import check, connect

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert check(spark, con, name, QUERIES[name], ORACLES.get(name), sf) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["class", "n", "total", "share", "flag"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
