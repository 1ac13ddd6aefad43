"""Every registered query with SQL agrees with DuckDB; those without run."""

import pytest

import harness
from corvane import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    ours = harness.frame(registry.QUERIES[name](spark, SMALL))
    if name in registry.ORACLE_SQL:
        assert harness.compare(ours, harness.oracle(registry.ORACLE_SQL[name], SMALL)) == ""
    else:
        assert len(ours)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "path"
    assert set(entry.oracle_sql()) <= set(entry.queries())
