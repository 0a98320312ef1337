"""Every registered query against its check SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from garimpo_checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
# The training-data operators have tests of their own and may be taken out.
QUERIES, CHECKS = entry.spark_queries.QUERIES, entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(CHECKS)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert len(rows.columns) == 43 and rows.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    verdict, rows = compare(spark, connection, SF, QUERIES[name], CHECKS[name])
    assert verdict == "" and rows > 0
