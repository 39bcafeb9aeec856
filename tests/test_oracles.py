"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

from conftest import SF_SMALL
from oracle import compare, duck_connection

import __spark_entry__ as entry_mod
from logweave.plans import all_oracles, all_queries

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name in ORACLES:
        # the file-manifest oracle names the sf0.01 folder; point it at the test tables
        sql = ORACLES[name].replace("/root/testdata/sf0.01/", SF_SMALL + "/")
        assert compare(df, con, sql) is None
    else:
        df.count()


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["field", "value", "n"]
    assert df.count() > 0
