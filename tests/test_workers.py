import pytest
from pyspark.sql import functions as F

from rewardmill.operators import groups as gr
from rewardmill.operators import workers as wk


def test_union_and_summary(spark):
    a = spark.createDataFrame([("p", "c1", 1.0)], "prompt string, completion string, reward double")
    b = spark.createDataFrame([("p", "c2", 0.0), ("q", "c3", 1.0)], "prompt string, completion string, reward double")
    merged = wk.aggregated_set(wk.union_workers([a, b]))
    assert merged.columns == ["prompt", "completion", "reward", "importance_weight", "worker_id"]
    summary = gr.aggregated_summary(merged).head()
    assert (summary["n_samples"], summary["mean_importance_weight"]) == (3, 1.0)
    per_worker = {r["worker_id"]: (r["n_responses"], r["mean_reward"]) for r in gr.worker_summary(merged).collect()}
    assert per_worker == {0: (1, 1.0), 1: (2, 0.5)}


def test_importance_weight_is_pluggable(spark):
    a = spark.createDataFrame([("p", "c1", 1.0)], "prompt string, completion string, reward double")
    merged = wk.aggregated_set(wk.union_workers([a]), lambda: F.lit(0.5) * F.col("reward"))
    assert merged.head()["importance_weight"] == 0.5


def test_first_match(spark):
    dataset = spark.createDataFrame(
        [(2, "p", "second"), (1, "p", "first"), (3, "q", "only")], "row_id int, prompt string, solution string"
    )
    responses = spark.createDataFrame(
        [(0, "p", ["a", "b"]), (1, "missing", ["c"])], "worker_id int, prompt string, completions array<string>"
    )
    flat = wk.flatten_completions(responses)
    rows = wk.attach_first_match(flat, dataset, "row_id").collect()
    got = sorted((r["completion"], r["row_id"], r["solution"]) for r in rows if r["solution"])
    assert got == [("a", 1, "first"), ("b", 1, "first")]
    assert [r["solution"] for r in rows if r["prompt"] == "missing"] == [None]


def test_rewards_travel_with_completions(spark):
    schema = "worker_id int, completions array<string>, rewards array<double>"
    df = spark.createDataFrame([(0, ["a", "b"], [0.0, 1.0]), (1, [], []), (2, None, None)], schema)
    assert sorted(map(tuple, wk.flatten_completions(df).collect())) == [(0, "a", 0.0), (0, "b", 1.0)]
    uneven = spark.createDataFrame([(0, ["a", "b"], [0.0])], schema)
    with pytest.raises(Exception, match="differ in length"):
        wk.flatten_completions(uneven).collect()
