import json
import os

import pytest

from rewardmill.operators import evaluation as ev
from rewardmill.registry import PRESETS, SFT_SOURCES, TRAINING_SOURCES
from rewardmill.sources import datasets, logs, results


def test_read_by_name(spark, tmp_path):
    locate = datasets.below(str(tmp_path), "json")
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    df.write.json(f"{tmp_path}/GAIR/LIMR/train")
    df.write.json(f"{tmp_path}/GAIR/LIMO/train")
    df.write.json(f"{tmp_path}/Idavidrein/gpqa/gpqa_diamond/train")
    df.write.json(f"{tmp_path}/open-r1/OpenR1-Math-220k/extended/train")
    assert datasets.read_training_set(spark, "limr", locate).count() == 1
    assert datasets.read_training_set(spark, "open_r1", locate, config="extended").count() == 1
    assert datasets.read_sft_set(spark, "qwen_rationale_limo", locate).count() == 1
    assert datasets.read_benchmark(spark, "gpqa:diamond", locate).count() == 1
    with pytest.raises(KeyError):
        datasets.read_training_set(spark, "nope", locate)
    with pytest.raises(KeyError):
        datasets.read_sft_set(spark, "nope", locate)


def test_formats_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([("q", 1)], "question string, n int")
    for fmt in datasets.FORMATS:
        path = f"{tmp_path}/{fmt}"
        df.write.format(fmt).save(path)
        back = datasets.read_location(spark, datasets.Location(path, fmt, "question string, n int"))
        assert tuple(back.head()) == ("q", 1)
    with pytest.raises(ValueError):
        datasets.read_location(spark, datasets.Location("x", "xml"))


def test_registries():
    assert len(TRAINING_SOURCES) == 22 and len(SFT_SOURCES) == 5
    assert {"l1_exact", "l1_max", "fastcurl"} <= set(TRAINING_SOURCES)
    assert PRESETS["open_rs3_drgrpo_ablation"].scale_rewards is False
    assert all(len(p.reward_names) == len(p.weights) for p in PRESETS.values())


def test_results_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    runs = spark.sql(
        "select 'org/m' model, 'aime24' task, 3 seed, 0.5D accuracy, 0.6D temperature, 0.95D top_p, 32768 max_new_tokens, "
        "cast(null as int) max_model_length, timestamp'2025-01-01 00:00:00' start_time, timestamp'2025-01-01 00:00:10' end_time"
    )
    results.write_results(results.result_records(runs), path)
    assert os.path.isdir(f"{path}/task=aime24/seed=3")
    file = next(f for f in os.listdir(f"{path}/task=aime24/seed=3") if f.endswith(".json"))
    record = json.loads(open(f"{path}/task=aime24/seed=3/{file}").readline())
    assert record["results"] == {"extractive_match": 0.5} and "max_model_length" in record
    back = results.read_results(spark, path)
    row = back.head()
    assert (row["task"], row["seed"], row["total_evaluation_time_seconds"]) == ("aime24", 3, 10.0)
    plan = spark.createDataFrame([("org/m", "aime24", 3), ("org/m", "aime24", 4)], "model string, task string, seed int")
    assert [r["seed"] for r in ev.pending_runs(plan, back).collect()] == [4]


def test_completion_and_metric_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(s, "p", f"c{s}", 1.0) for s in range(6)], "step int, prompt string, completion string, reward double")
    logs.append_completions(rows, path, 2)
    assert sorted(r["step"] for r in logs.read_completions(spark, path).collect()) == [0, 2, 4]
    logs.append_completions(rows.drop("reward").limit(1), str(tmp_path / "fixed"))
    assert "reward" not in logs.read_completions(spark, str(tmp_path / "fixed")).columns
    mpath = str(tmp_path / "metrics")
    long = spark.createDataFrame([("r", 1, "loss", 2.0), ("r", 1, "kl", 3.0)], "run_id string, step int, name string, value double")
    logs.append_metrics(long, mpath)
    logs.append_metrics(long, mpath, evaluation=True)
    wide = logs.metrics_wide(logs.read_metrics(spark, mpath), ["loss", "eval_loss"]).head()
    assert (wide["loss"], wide["eval_loss"]) == (2.0, 2.0)
