"""Every registered query against its SQL, on whole small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import workloads.queries
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in ORACLES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(workloads.queries.QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(spark, con, SF, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
