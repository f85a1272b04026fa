"""Every registered query against its DuckDB twin."""

import pytest

from tests.compare import compare, duck_connection
from workloads import load_all
from workloads.registry import ORACLES, QUERIES

load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(name, spark, duck, sf_dir):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).collect()[0]
    assert row["source"] == 1500 and row["mismatched"] > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
