import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rewardmill.operators import groups as gr
from rewardmill.operators import skew


def scored(spark, rows):
    df = spark.createDataFrame(rows, "id int, prompt_id int, reward double")
    return df.withColumns({"run_id": F.lit("r"), "step": F.lit(0)})


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_advantages(spark):
    df = scored(spark, [(0, 1, 1.0), (1, 1, 0.0), (2, 1, 0.0), (3, 1, 1.0), (4, 2, 5.0)])
    got = gr.with_advantages(df)
    assert by_id(got, "group_std")[0] == pytest.approx(0.577350, abs=1e-6)
    assert by_id(got, "advantage")[0] == pytest.approx(0.865875, abs=1e-6)
    assert by_id(got, "advantage")[1] == pytest.approx(-0.865875, abs=1e-6)
    assert by_id(got, "advantage")[4] is None
    assert by_id(gr.with_advantages(df, scale=False), "advantage")[4] == 0.0


def test_a_group_with_a_third_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else i // 4 + 100, rng.random()) for i in range(3000)]
    got = gr.with_advantages(scored(spark, rows))
    hot = [r for _, p, r in rows if p == 7]
    assert got.count() == 3000
    assert by_id(got, "group_std")[0] == pytest.approx(statistics.stdev(hot))
    assert by_id(got, "group_mean")[0] == pytest.approx(statistics.mean(hot))


def test_null_keys_form_a_group(spark):
    rows = [(i, None if i % 2 else i, float(i)) for i in range(200)]
    got = by_id(gr.with_advantages(scored(spark, rows), scale=False), "advantage")
    assert all(got[i] == (i - 100.0 if i % 2 else 0.0) for i in range(200))


def test_steps_of_one_prompt_are_groups_of_their_own(spark):
    rows = [(0, 1, 1, 1.0), (1, 1, 1, 0.0), (2, 2, 1, 1.0), (3, 2, 1, 1.0)]
    df = spark.createDataFrame([("r", *r) for r in rows], "run_id string, id int, step int, prompt_id int, reward double")
    assert by_id(gr.with_advantages(df), "group_mean") == {0: 0.5, 1: 0.5, 2: 1.0, 3: 1.0}


def test_no_job_while_a_plan_is_built(spark):
    df = scored(spark, [(i, i % 3, 1.0) for i in range(30)])
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    gr.complete_groups_only(gr.with_advantages(df), 10)
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_adaptive_execution_splits_a_hot_group(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).selectExpr(
            "id", "'r' AS run_id", "0 AS step", "IF(id % 2 = 0, 7, id) AS prompt_id", "rand(1) AS reward"
        )
        got = gr.with_advantages(rows)
        assert got.count() == 200_000
        got.write.format("noop").mode("overwrite").save()
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_keys_are_refused(spark):
    with pytest.raises(ValueError):
        gr.with_advantages(scored(spark, [(0, 1, 1.0)]), [])


def test_advantages_sum_to_zero(spark):
    rng = random.Random(5)
    df = scored(spark, [(i, i // 4, rng.random()) for i in range(400)])
    sums = gr.with_advantages(df).groupBy("prompt_id").agg(F.sum("advantage").alias("s")).collect()
    assert max(abs(r["s"]) for r in sums) < 1e-9


def test_completeness(spark):
    df = scored(spark, [(i, 1, 0.0) for i in range(4)] + [(10 + i, 2, 0.0) for i in range(3)])
    assert [tuple(r) for r in gr.incomplete_groups(df, 4).collect()] == [("r", 0, 2, 3)]
    assert {r["id"] for r in gr.complete_groups_only(df, 4).collect()} == {0, 1, 2, 3}
    many = df.unionByName(scored(spark, [(100 + i, 9, 0.0) for i in range(50)]))
    assert {r["id"] for r in gr.complete_groups_only(many, 4).collect()} == {0, 1, 2, 3}
    gr.check_generations(8, 2, 4)
    with pytest.raises(ValueError):
        gr.check_generations(3, 1, 2)


def test_step_metrics_skip_and_count_missing(spark):
    df = spark.createDataFrame(
        [("r", 1, 1.0, None, 1.0, 0.5), ("r", 1, 0.0, 1.0, 2.0, 0.5), ("r", 1, None, None, 0.0, 0.5)],
        "run_id string, step int, a double, b double, reward double, group_std double",
    )
    row = gr.step_metrics(df, ["a", "b"]).head()
    assert (row["mean_a"], row["mean_b"], row["unscored_b"], row["n_unscored"]) == (0.5, 1.0, 2, 1)
    long = {r["name"]: r["value"] for r in gr.to_long_metrics(gr.step_metrics(df, ["a"])).collect()}
    assert long["mean_reward"] == 1.0 and long["n_rows"] == 3.0


def test_log_points(spark):
    df = spark.createDataFrame(
        [("r", 0, "loss", 1.0), ("r", 9, "loss", 3.0), ("r", 10, "loss", 5.0)],
        "run_id string, step int, name string, value double",
    )
    got = {(r["log_point"], r["name"]): r["value"] for r in gr.log_points(df, 10, evaluation=True).collect()}
    assert got == {(0, "eval_loss"): 2.0, (1, "eval_loss"): 5.0}


def test_left_join_unique(spark):
    left = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(300)], "id int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 200)], "k int, v string")
    got = {r["id"]: r["v"] for r in skew.left_join_unique(left, right, ["k"]).collect()}
    assert len(got) == 300 and got[299] is None and got[0] == "v0" and got[1] == "v1"
    with pytest.raises(Exception, match="several rows for one key"):
        skew.left_join_unique(left, right.union(right.filter("k = 5")), ["k"]).collect()


def test_std_is_sample_deviation(spark):
    df = scored(spark, [(0, 1, 1.0), (1, 1, 3.0)])
    assert by_id(gr.with_advantages(df), "group_std")[0] == pytest.approx(math.sqrt(2))


def test_joined_stats_equal_windowed_stats(spark):
    rows = [(i, None if i % 5 == 0 else (7 if i % 3 == 0 else i // 4), float(i % 11)) for i in range(600)]
    df = scored(spark, rows)
    stats = {"top": F.max("reward"), "n": F.count(F.lit(1))}
    want = {tuple(r) for r in skew.with_group_stats(df, ["prompt_id"], stats).collect()}
    got = skew.join_group_stats(df, ["prompt_id"], stats).collect()
    assert len(got) == 600 and {tuple(r) for r in got} == want
