"""Every query with SQL against DuckDB on the smallest tables."""

import os
import sys

import pytest

from textledger.plans import registry

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    oracle.same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries())
