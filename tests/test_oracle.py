"""Every registered query against its DuckDB oracle on the smallest test tables,
and free of nested-loop or cartesian joins."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import oracle_check  # noqa: E402

import __spark_entry__ as entry_mod  # noqa: E402

SF = "/root/testdata/sf0.001"
from evalframe.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    return oracle_check.duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLES) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    res = oracle_check.compare(spark, duck, name, lambda _s, _d: df, ORACLES.get(name), SF)
    assert res["status"] == "match", res
    assert "type_diff" not in res, res


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["metric", "value", "n"]
