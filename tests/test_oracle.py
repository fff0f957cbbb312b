"""Every query agrees with its SQL; the numbered problems, which have none, are tested by themselves."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, folder, con, name):
    assert compare.difference(QUERIES[name](spark, folder), con, SQL[name]) == ""


def test_every_core_query_has_sql():
    assert {n for n in set(QUERIES) - set(SQL) if not (n[0] == "p" and n[1].isdigit())} == set()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
