"""Every registered query against its SQL on the smallest data folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
import check_oracles as CO  # noqa: E402
from claimlens.plans import all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return CO.connect(SF)


def test_every_query_has_sql():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(all_queries.SQL) == set(all_queries.QUERIES)


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(E.oracle_sql()))
def test_query(spark, con, name):
    got = CO.rows_of_spark(E.queries()[name](spark, SF))
    assert got[1], "no rows"
    assert CO.compare(got, CO.rows_of_duckdb(con, E.oracle_sql()[name])) is None
