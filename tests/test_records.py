import random
import statistics

import pytest
from pyspark.sql import functions as F

from rewardmill.operators import list_rewards as lr
from rewardmill.operators import running as ru
from rewardmill.operators import sampling as sa
from rewardmill.plans.record_queries import brevity_rank
from rewardmill.sources import logs, results


def runs(spark, rows):
    """(model, seed, accuracy, second of the end)"""
    df = spark.createDataFrame(rows, "model string, seed int, accuracy double, s int")
    return results.result_records(
        df.selectExpr(
            "model", "'aime24' task", "seed", "accuracy", "0.6D temperature", "0.95D top_p", "32768 max_new_tokens", "32768 max_model_length",
            "timestamp'2025-01-01 00:00:00' start_time", "timestamp_seconds(1735689600 + s) end_time",
        )
    )


def accuracies(spark, path):
    return {(r["model"], r["seed"]): r["results"]["extractive_match"] for r in results.read_results(spark, path).collect()}


def test_a_repeated_run_takes_the_place_of_its_record(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = runs(spark, [("org/a", 1, 0.1, 5), ("org/a", 2, 0.2, 5), ("org/b", 1, 0.3, 5)])
    results.replace_results(first, path)
    results.replace_results(first, path)
    assert accuracies(spark, path) == {("org/a", 1): 0.1, ("org/a", 2): 0.2, ("org/b", 1): 0.3}
    results.replace_results(runs(spark, [("org/a", 1, 0.5, 9), ("org/a", 1, 0.4, 8)]), path)
    assert accuracies(spark, path) == {("org/a", 1): 0.5, ("org/a", 2): 0.2, ("org/b", 1): 0.3}
    assert results.read_results(spark, path).count() == 3


def test_blocks_of_metrics_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "metrics")

    def log(rows, evaluation=False):
        logs.replace_metrics(spark.createDataFrame(rows, "run_id string, step bigint, name string, value double"), path, 10, evaluation)

    first = [("a", 0, "loss", 1.0), ("a", 9, "loss", 2.0), ("a", 10, "loss", 3.0), ("b", 9, "loss", 4.0), (None, 3, "loss", None)]
    for _ in range(2):
        log(first)
    log([("a", 9, "loss", 7.0)], evaluation=True)
    log([("a", 4, "loss", 5.0)])
    got = {(r.run_id, r.step, r.name, r.value) for r in logs.read_metrics(spark, path).collect()}
    assert got == {("a", 4, "loss", 5.0), ("a", 9, "eval_loss", 7.0), *first[2:]}
    assert logs.read_metrics(spark, path).count() == 5
    assert logs.read_metrics(spark, path).columns == ["step", "name", "value", "run_id"]


def test_steps_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(s, "p", f"c{s}") for s in (1, 1, 2)], "step int, prompt string, completion string")
    logs.replace_completions(rows, path)
    logs.replace_completions(rows.filter("step = 1").withColumn("completion", F.lit("new")), path)
    assert sorted(tuple(r) for r in logs.read_completions(spark, path).select("step", "completion").collect()) == [(1, "new"), (1, "new"), (2, "c2")]


def test_every_line_is_a_record_or_damaged(spark, tmp_path):
    path = str(tmp_path / "lines")
    good = '{"model":"m","task":"t","seed":1,"results":{"x":0.5}}'
    bad = [good[:-4], '{"model":"m","task":"t","seed":"one","results":{"x":0.5}}', "{}", "[1]", "word", '{"model":null,"task":"t","results":{"x":1.0}}', "null"]
    spark.createDataFrame([(x,) for x in [good, *bad, "", "  ", good]], "value string").write.text(path)
    assert [r["seed"] for r in results.read_results(spark, path).collect()] == [1, 1]
    damaged = results.damaged_results(spark, path).collect()
    assert sorted(r["line"] for r in damaged) == sorted(bad) and all(r["file"] for r in damaged)


def test_damaged_lines_in_named_folders(spark, tmp_path):
    path = str(tmp_path / "named")
    results.write_results(runs(spark, [("org/a", 1, 0.1, 5)]), path)
    (tmp_path / "named" / "task=aime24" / "seed=1" / "cut.json").write_text('{"model":"org')
    assert [(r["task"], r["seed"]) for r in results.read_results(spark, path).collect()] == [("aime24", 1)]
    assert results.damaged_results(spark, path).count() == 1


def test_merged_states_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([None, rng.gauss(1e6, 1)]), i % 3) for i in range(300)] + [("only", 2.0, 1), ("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, x double, batch int")
    path = str(tmp_path / "states")
    for batch in (0, 1, 1, 2, 2):
        ru.update_states(spark, path, ru.states_of(df.filter(F.col("batch") == batch), ["k"], "x"), ["k"], batch)
    got = {r["k"]: r for r in ru.finished(ru.read_states(spark, path, 2), ["k"]).collect()}
    for k in "abc":
        values = [x for g, x, _ in rows if g == k and x is not None]
        assert got[k]["n"] == len(values) and got[k]["best"] == max(values)
        assert got[k]["mean"] == pytest.approx(statistics.fmean(values), abs=1e-6)
        assert got[k]["std"] == pytest.approx(statistics.stdev(values), rel=1e-6)
    assert tuple(got["only"])[1:] == (2.0, None, 2.0, 1) and tuple(got["none"])[1:] == (None, None, None, 0)
    with pytest.raises(ValueError, match="no states after batch 6"):
        ru.update_states(spark, path, ru.states_of(df, ["k"], "x"), ["k"], 7)


def groups(spark):
    """A group with most rows, small ones, one of a single row, and one whose key is null."""
    rows = [("hot", i, i % 37) for i in range(900)] + [(f"g{i % 50}", i, i % 11) for i in range(900, 1200)] + [("one", 0, 5)] + [(None, i, i) for i in range(4)]
    return rows, spark.createDataFrame(rows, "g string, id int, length bigint")


def ranks(rows):
    by = {}
    for g, i, n in rows:
        by.setdefault(g, []).append(n)
    return {(g, i): sum(m > n for m in by[g]) / (len(by[g]) - 1) if len(by[g]) > 1 else None for g, i, n in rows}


@pytest.mark.parametrize("block_bytes", [600, 2000, 1 << 20])
def test_list_reward_is_the_same_for_blocks_of_every_size(spark, block_bytes):
    rows, df = groups(spark)
    got = lr.score_lists(df, brevity_rank(), ["g"], ["id"], block_bytes)
    held = [((r["g"], r["id"]), r["brevity_rank"]) for r in got.collect()]
    assert len(held) == len(rows) and dict(held) == pytest.approx(ranks(rows))


def test_list_reward_without_a_merge_gets_whole_groups_or_fails(spark):
    rows, df = groups(spark)
    whole = lr.ListReward("longest", lambda part, _: (part["length"] == part["length"].max()).astype(float), ["length"])
    got = {(r["g"], r["id"]): r["longest"] for r in lr.score_lists(df, whole, ["g"], ["id"]).collect()}
    assert got[("hot", 36)] == 1.0 and got[("hot", 35)] == 0.0 and got[(None, 3)] == 1.0 and got[("one", 0)] == 1.0
    with pytest.raises(Exception, match="give the reward a merge"):
        lr.score_lists(df, whole, ["g"], ["id"], 2000).collect()
    with pytest.raises(Exception, match="gave 1 scores"):
        lr.score_lists(df, lr.ListReward("short", lambda part, _: [1.0], ["length"]), ["g"], ["id"]).collect()


def test_list_reward_of_nothing(spark):
    _, df = groups(spark)
    assert lr.score_lists(df.filter("false"), brevity_rank(), ["g"], ["id"]).count() == 0
    with pytest.raises(ValueError, match="columns that"):
        lr.score_lists(df.withColumn("brevity_rank", F.lit(1)), brevity_rank(), ["g"], ["id"])


@pytest.mark.parametrize("n", [0, 1, 7, 99, 100, 500])
def test_sample_by_counting_passes(spark, n):
    df = spark.range(100).withColumn("wide", F.lit("w"))
    rows = sa.sample_rows(df, n, 5, ["id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Scan ExistingRDD" not in plan
    assert len({r["id"] for r in rows.collect()}) == rows.count() == min(n, 100)


def test_sample_that_would_end_inside_a_repeated_key_fails(spark):
    df = spark.createDataFrame([(1,)] * 3, "id int")
    with pytest.raises(ValueError, match="several rows for one key"):
        sa.sample_rows(df, 2, 5, ["id"])
