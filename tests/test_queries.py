"""Every registered query against its SQL check, or at least non-empty with unique column names."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

CHECKS, QUERIES = oracle_sql(), queries()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, small, duck, name):
    status, _, _ = compare(spark, duck, small, name, QUERIES[name], CHECKS[name])
    assert status == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
