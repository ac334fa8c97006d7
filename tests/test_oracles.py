"""Every query against its SQL counterpart, on the smallest tables."""

import os

import pytest

from checks import compare
from checks.catalog import QUERIES
from checks.oracles import oracle_sql

SF = "/root/testdata/sf0.001"
# Ten protocols only: hardly any block lies in a poll window.
MAY_BE_EMPTY = {"window_transactions", "backfill_new_protocol", "poll_windows"}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    problem = compare.compare(spark, con, name, SF)
    assert problem == "" or (problem == "no rows" and name in MAY_BE_EMPTY)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
