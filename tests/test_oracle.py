"""Every registered query equals its DuckDB oracle at sf0.01 (rows, column
names and sorted values), as the driver's correctness gate checks."""

import pytest

import __spark_entry__ as E  # noqa: E402
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"
from slotvalue.plans.catalog import QUERIES  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle_or_a_brute_force_test():
    assert set(QUERIES) - set(SQL) == {"doc_fuzzy"}  # test_fuzzy.py


@pytest.mark.parametrize("key", sorted(set(QUERIES) & set(SQL)))
def test_query_matches_oracle(spark, con, key):
    _, problems = compare(spark, con, key, QUERIES[key], SQL[key], SF)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
