"""Every registered query against its SQL twin, on whole tables of the smallest scale."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"
# an axis needs two lines, and the smallest scale has a single grid row of users
TWO_ROWS = {"jn13_regrid_nearest", "jn15_geometry_confidence"}
TWO_ROWS_SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return {sf: duck(sf) for sf in (SF, TWO_ROWS_SF)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, con):
    sf = TWO_ROWS_SF if name in TWO_ROWS else SF
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        message, _ = compare(df, con[sf], ORACLES[name])
        assert message is None, message
    else:
        df.collect()


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracle_keys_are_queries():
    assert set(ORACLES) <= set(QUERIES)
