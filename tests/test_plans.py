"""Physical plans at scale: early rank limits, pushed filters, split hot keys, shared shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from propflow.operators import context, crosswalk, exemplars, lookup, retrieval
from propflow.operators.crosswalk import build_crosswalk
from propflow.sources import sinks, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Sets session options for one test."""
    before = {}

    def put(**options):
        for key, value in options.items():
            name = key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_top_snippets_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("e", 1, 2, "s")], "e string, d int, score int, snippet string")
    plan = plan_of(retrieval.top_snippets(df, "e", ["d"]))
    early, late = plan.index("Final"), plan.index("Partial")
    assert early < plan.index("Exchange hashpartitioning") < late


def test_nearest_rows_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, x double")
    plan = plan_of(exemplars.nearest_to_median(df, "x", "id", [0.0, 5.0], [2.5]))
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_context_is_thinned_in_shares_first(spark):
    df = spark.createDataFrame([("e", 1, "x")], "e string, o int, t string")
    plan = plan_of(context.capped_context(df, "e", F.col("t"), ["o"], spread=4))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 2 and "_share" in keys[1] and "_share" not in keys[0]


def test_lookup_shares_the_shuffle_of_the_store(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    store = spark.createDataFrame([(1, [1], "p")], "row int, t array<int>, p string")
    queries = spark.createDataFrame([([1],)], "t array<int>")
    plan = plan_of(lookup.lookup_sequences(queries, store, "t", "row", ["p"]))
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "EPA DSSTox", "D1", "x")], "cid int, source_name string, v string, other string")
    path = sinks.write_table(df, str(tmp_path / "t"))
    plan = plan_of(build_crosswalk(tables.read_table(spark, path), "cid", "v"))
    assert "EqualTo(source_name,EPA DSSTox)" in plan
    assert "other" not in plan.split("ReadSchema:")[1]


def test_hot_key_of_a_join_is_split(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    rows = spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    pairs = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("k"), F.concat(F.lit("D"), "id").alias("dsstox"))
    joined = crosswalk.attach_ids(rows, pairs, "k", "inner")
    assert len(joined.collect()) == 60_000
    assert "skew=true" in plan_of(joined)
