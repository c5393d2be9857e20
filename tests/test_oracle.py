"""Every registered key against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from shoptally.plans.catalog import QUERIES
from shoptally.plans.oracle_sql import ORACLE
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck_connect


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


def test_all_keys_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLE), sorted(set(QUERIES) ^ set(ORACLE))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    problems, n, _, _ = compare(spark, duck, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert not problems, "\n".join(problems)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "opening_stock" in df.columns
