"""Every registered query: oracle rows where SQL can say it, else rows at all."""

import pytest

import __spark_entry__ as entry
from cinderframe.plans.catalog import ORACLES, QUERIES
from oracle import compare, duck

SLOW = {"l8_variant_matrix"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 112
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
