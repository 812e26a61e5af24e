import re

import pytest

import __spark_entry__ as registered
from compare import compare, connect
from rewardmill.plans import catalog
from rewardmill.plans import views as v
from rewardmill.operators import groups as gr
from rewardmill.operators import scoring as sc
from rewardmill.registry import PRESETS

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, small, name):
    assert compare(spark, con, small, name, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return [line for line in plan.splitlines() if re.search(r"Exchange (hash|range|Single|RoundRobin)", line)]


def test_advantages_shuffle_no_text(spark, small):
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    rollouts = v.rollouts(spark, small, lineitem=rows)
    scored = sc.score_preset(rollouts, PRESETS["deepscaler"], keep=list(gr.GROUP_KEYS))
    plan = plan_of(gr.with_advantages(scored))
    assert "Window" not in plan
    outer = plan.split("InMemoryRelation")[0]
    assert "completion" not in outer and "__text" not in outer


@pytest.mark.parametrize("name", ["shard_shuffled", "repeat_sample", "minibatches", "shard_contiguous", "process_slice"])
def test_ranks_never_sort_in_one_task(spark, small, name):
    assert "SinglePartition" not in plan_of(QUERIES[name](spark, small))


def test_scan_reads_only_needed_columns(spark, small):
    plan = plan_of(QUERIES["incomplete_groups"](spark, small))
    schema = re.search(r"lineitem.parquet.*?ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_aggregated_set_keeps_no_text(spark, small):
    plan = plan_of(QUERIES["aggregated_set"](spark, small))
    assert "InMemoryRelation" not in plan
    # Each worker's rows are chosen as they are read, before they are dealt out and scored.
    assert len(re.findall(r"Filter .*pmod\(l_suppkey", plan)) == 3


def test_rows_are_dealt_to_several_tasks_a_core(spark, small):
    lines = v.spread(v.table(spark, small, "lineitem"))
    assert lines.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
