import pytest
from pyspark.sql import functions as F

from rewardmill.operators import evaluation as ev
from rewardmill.registry import BASELINE_MODELS, GRID_TASKS, TASKS


def test_math_docs(spark):
    df = spark.createDataFrame([("what {A} is", "$1$")], "problem string, solution string")
    row = ev.eval_docs(df, TASKS["math_500"]).head()
    assert row["query"].startswith("Solve the following math problem efficiently and clearly.  The last line")
    assert "$\\boxed{ANSWER}$" in row["query"] and row["query"].endswith("\n\nwhat {A} is")
    assert (row["choices"], row["gold_index"], row["task_name"]) == (["$1$"], 0, "math_500")


@pytest.mark.parametrize("name", [t for t in TASKS if TASKS[t].metric != "choice"])
def test_each_math_task_reads_its_columns(spark, name):
    task = TASKS[name]
    df = spark.createDataFrame([("Q", "G")], f"{task.question} string, {task.gold} string")
    row = ev.eval_docs(df, task).head()
    assert row["query"].endswith("Q") and row["choices"] == ["G"]


def test_choice_docs(spark):
    columns = ["id", "Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"]
    df = spark.createDataFrame([(i, "Q?", "c", "x", "y", "z") for i in range(100)], columns)
    rows = ev.eval_docs(df, TASKS["gpqa:diamond"], row_key=["id"]).collect()
    assert {r["gold_index"] for r in rows} == {0, 1, 2, 3}
    third = next(r for r in rows if r["gold_index"] == 2)
    assert third["query"].endswith("Q?\n\nA) x\nB) y\nC) c\nD) z")
    assert third["instruction"] == third["query"] and third["choices"] == ["A", "B", "C", "D"]


def scores(spark, matcher, rows, schema="gold string, prediction string"):
    return [r["score"] for r in matcher(spark.createDataFrame(rows, schema)).collect()]


def test_matching(spark):
    rows = [
        ("$\\frac{7}{2}$", "so \\boxed{3.5}"),
        ("$\\frac{7}{2}$", "I get 3.5"),
        ("$\\frac{7}{2}$", "I get 3.6"),
        ("4", "thus $4.000001$"),
        ("4", ""),
    ]
    assert scores(spark, ev.match_expression, rows) == [1.0, 1.0, 0.0, 1.0, 0.0]
    assert scores(spark, ev.match_latex, rows) == [1.0, 1.0, 0.0, 0.0, 0.0]
    choice = [(1, "Answer: B"), (1, "Answer: $B"), (2, "Answer: B"), (0, "no")]
    assert scores(spark, ev.match_choice, choice, "gold_index int, prediction string") == [1.0, 1.0, 0.0, 0.0]


def test_best_of_golds(spark):
    df = spark.createDataFrame([(1, ["$1$", "$2$"], "\\boxed{2}")], "doc int, golds array<string>, prediction string")
    assert ev.best_of_golds(df, ["doc"]).head()["score"] == 1.0


def test_metrics_can_be_plugged_in(spark):
    ev.register_metric("any", ev.Matcher(F.lower, F.lower, lambda gold, prediction: gold == prediction))
    df = spark.createDataFrame([(1, ["x", "y"], "Y")], "doc int, golds array<string>, prediction string")
    assert ev.best_of_golds(df, ["doc"], metric="any").head()["score"] == 1.0
    assert ev.match(df.withColumn("gold", F.lit("z")), "any").head()["score"] == 0.0


def test_accuracy_and_leaderboard(spark):
    rows = [("m", "t", s, x) for s, x in ((0, 1.0), (0, 0.0), (1, 1.0), (1, 1.0))]
    runs = ev.task_accuracy(spark.createDataFrame(rows, "model string, task string, seed int, score double"))
    board = ev.leaderboard(runs).head()
    assert board["mean_accuracy"] == 0.75 and board["n_seeds"] == 2
    assert board["std_accuracy"] == pytest.approx(0.353553, abs=1e-6)
    marks = spark.createDataFrame([("b", "c2", 0.5), ("b", "c1", 0.5), ("b", "c0", 0.1)], "base string, checkpoint string, mean_accuracy double")
    assert tuple(ev.best_checkpoint(marks, ["base"]).head()) == ("b", "c1", 0.5)


def test_grid(spark):
    models = spark.createDataFrame([(m,) for m in BASELINE_MODELS], "model string")
    grid = ev.run_grid(models)
    assert grid.count() == 12 * 10 * 6
    limits = {r["model"]: r["max_new_tokens"] for r in grid.select("model", "max_new_tokens").distinct().collect()}
    assert limits["Qwen/Qwen2.5-Math-1.5B"] == 4096 and set(limits.values()) == {4096, 32768}
    row = grid.filter("seed = 0 and task = 'aime24' and model = 'knoveleng/Open-RS3'").head()
    assert row["run_key"] == "0-0.6-0.95-aime24-32768" and row["folder"] == "knoveleng_Open-RS3"
    done = grid.filter("task = 'aime24'")
    assert ev.pending_runs(grid, done).count() == 12 * 10 * (len(GRID_TASKS) - 1)
    assert ev.pending_runs(grid, done, overwrite=True).count() == 720


def test_run_key(spark):
    df = spark.createDataFrame([(None, True), (-1, True), (4096, False)], "requested int, chat boolean")
    limit = ev.max_model_length(F.col("requested"), F.lit(32768))
    key = ev.run_key(F.lit(0), F.lit(0.6), F.lit(0.95), F.lit("aime24"), F.lit(32768), limit, F.col("chat"))
    assert [r[0] for r in df.select(key).collect()] == [
        "0-0.6-0.95-aime24-32768",
        "0-0.6-0.95-aime24-32768-None",
        "0-0.6-0.95-aime24-32768-4096-nochat",
    ]


def test_model_id_and_duration(spark):
    df = spark.sql("select timestamp'2025-01-01 00:00:00' s, timestamp'2025-01-01 00:01:00.5' e")
    assert df.select(ev.duration_seconds(F.col("s"), F.col("e"))).head()[0] == 60.5
    row = df.select(ev.model_id(F.lit("m"), F.lit("grpo"), F.lit("still"), F.lit("checkpoint-5"))).head()
    assert row[0] == "m_grpo_still_checkpoint-5"
