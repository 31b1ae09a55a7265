"""Every registered query against its check SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from curatorium.plans.registry import CHECKS, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, problems = compare(QUERIES[name](spark, SF_DIR), con, CHECKS[name])
    assert not problems


def test_the_entry_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_check_has_a_query():
    assert set(CHECKS) == set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "tier", "reason", "score"] and df.count() > 0
