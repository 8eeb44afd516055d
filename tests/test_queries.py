"""Every registered query against its oracle, and the shape of every plan."""

import re

import pytest

from sitehex.plans import compare, registry

registry.load()


@pytest.fixture(scope="module")
def duck(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoopJoin|PythonUDF|MapInPandas|ArrowEval|FlatMapGroups", plan)
    if name in registry.ORACLES:
        assert compare.difference(df, duck, registry.ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
