"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from propflow.catalog import ORACLE, QUERIES
from tools.oracle import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "BatchEvalPythonUDTF")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, duck, ORACLE[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BAD_NODES if node in plan]


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["dsstox", "details"]
