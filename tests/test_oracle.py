"""Every query with SQL against DuckDB on the smallest tables."""

import oracle
import pytest

from graphloom import registry


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(name, spark, con, sf):
    assert oracle.compare(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, sf):
    registry.QUERIES[name](spark, sf).collect()
