"""Registered queries: matching, accuracy, leaderboards, run grid, records and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.functions import rewards as rw
from rewardmill.operators import evaluation as ev
from rewardmill.operators import groups as gr
from rewardmill.operators import scoring as sc
from rewardmill.plans import oracle as o
from rewardmill.plans import views as v
from rewardmill.registry import GRID_TASKS, PRESETS
from rewardmill.session import scratch_path
from rewardmill.sources import logs, results

KEY = list(v.EVAL_KEY)
_KEY_SQL = ", ".join(KEY)
LOG_EVERY = 100


def _match(matcher):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matcher(v.predictions(spark, sf_dir)).select(*KEY, "model", "score")

    return run


def best_of_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against two golds, the second one off by one."""
    other = F.regexp_replace("gold", r"\\frac", r"1+\\frac")
    rows = v.predictions(spark, sf_dir).withColumn("golds", F.array("gold", other))
    return ev.best_of_golds(rows, ["doc", "model"])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.task_accuracy(ev.match_expression(v.predictions(spark, sf_dir)))


def task_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("model", "task", "seed", *v.rounded("accuracy"), "n_docs")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = ev.leaderboard(_runs(spark, sf_dir))
    return board.select("model", "task", *v.rounded("mean_accuracy", "std_accuracy", "best_accuracy"), "n_seeds")


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ev.match_expression(v.predictions(spark, sf_dir))
    runs = ev.task_accuracy(scored, ["base", "checkpoint", "task", "seed"])
    board = ev.leaderboard(runs, ["base", "checkpoint", "task"])
    best = ev.best_checkpoint(board, ["base", "task"])
    return best.select("base", "task", "checkpoint", *v.rounded("mean_accuracy"))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's model over all seeds and tasks."""
    name = ev.model_id(F.lit("org/base"), F.lit("grpo"), F.lit("still"), F.col("s_name"))
    models = v.table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("model"))
    return ev.run_grid(models)


def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("folder", "run_key", "seed", "task", "max_new_tokens")


def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without runs that an order stands for as done."""
    n = v.table(spark, sf_dir, "supplier").count()
    tasks = F.array(*[F.lit(t) for t in GRID_TASKS])
    done = v.table(spark, sf_dir, "orders").select(
        F.pmod("o_custkey", F.lit(n)).alias("s_suppkey"),
        F.pmod("o_orderkey", F.lit(10)).cast("int").alias("seed"),
        F.element_at(tasks, (F.pmod("o_custkey", F.lit(6)) + 1).cast("int")).alias("task"),
    )
    plan = _planned(spark, sf_dir)
    return ev.pending_runs(plan, done, ["s_suppkey", "seed", "task"]).select("model", "seed", "task")


def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result keys of one run per order, with and without length limits and chat templates."""
    kind = F.pmod("o_orderkey", F.lit(3))
    requested = F.when(kind == 1, F.lit(-1)).when(kind == 2, F.lit(4096))
    rows = v.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.pmod("o_orderkey", F.lit(10)).alias("seed"),
        ev.max_model_length(requested, F.lit(32768)).alias("max_model_length"),
        (F.pmod("o_custkey", F.lit(2)) == 0).alias("chat"),
        ev.model_folder(F.concat(F.lit("org/m"), F.col("o_custkey").cast("string"))).alias("folder"),
    )
    key = ev.run_key(
        F.col("seed"), F.lit(0.6), F.lit(0.95), F.lit("aime24"), F.lit(32768), F.col("max_model_length"), F.col("chat")
    )
    return rows.select("o_orderkey", "folder", key.alias("run_key"))


def result_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON and read back; the run's times come from its first and last line."""
    lines = v.table(spark, sf_dir, "lineitem")
    times = lines.groupBy(
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("model"), F.col("l_linenumber").alias("seed")
    ).agg(
        F.min("l_shipdate").cast("timestamp").alias("start_time"),
        F.max("l_shipdate").cast("timestamp").alias("end_time"),
    )
    runs = _runs(spark, sf_dir).join(times, ["model", "seed"])
    limit = F.lit(32768)
    records = results.result_records(
        runs.withColumn("temperature", F.lit(0.6))
        .withColumn("top_p", F.lit(0.95))
        .withColumn("max_new_tokens", limit)
        .withColumn("max_model_length", limit)
    )
    path = scratch_path(spark, "results")
    results.write_results(records, path)
    back = results.read_results(spark, path)
    return back.select(
        "model",
        "task",
        "seed",
        (F.round(F.col("results")["extractive_match"], 6) + 0.0).alias("accuracy"),
        *v.rounded("total_evaluation_time_seconds"),
        "temperature",
        "launcher_type",
    )


def completion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of every hundredth step, appended and read back."""
    scored = sc.score_preset(
        v.rollouts(spark, sf_dir), PRESETS["deepscaler"], keep=["prompt_id", "step", "completion"]
    )
    rows = scored.withColumn("prompt", F.concat(F.lit("order "), F.col("prompt_id").cast("string")))
    path = scratch_path(spark, "completions")
    logs.append_completions(rows, path, LOG_EVERY)
    back = logs.read_completions(spark, path)
    return back.select(F.col("step").cast("bigint").alias("step"), "prompt", "completion", *v.rounded("reward"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step metrics appended in long form and read back wide."""
    rewards = [rw.format_tags(), rw.accuracy()]
    keep = ["prompt_id", "run_id", "step"]
    scored = sc.score(v.rollouts(spark, sf_dir), rewards, [1.0, 2.0], keep=keep)
    wide = gr.step_metrics(gr.with_advantages(scored, ["run_id", "step", "prompt_id"]), ["format", "accuracy"])
    path = scratch_path(spark, "metrics")
    logs.append_metrics(gr.to_long_metrics(wide), path)
    back = logs.metrics_wide(logs.read_metrics(spark, path), ["mean_format", "mean_reward"])
    return back.select("run_id", "step", *v.rounded("mean_format", "mean_reward"))


QUERIES = {
    "match_expr": _match(ev.match_expression),
    "match_latex": _match(ev.match_latex),
    "match_choice": _match(ev.match_choice),
    "best_of_golds": best_of_golds,
    "task_accuracy": task_accuracy,
    "leaderboard": leaderboard,
    "best_checkpoint": best_checkpoint,
    "run_grid": run_grid,
    "pending_runs": pending_runs,
    "run_keys": run_keys,
    "result_json_roundtrip": result_json_roundtrip,
    "completion_log": completion_log,
    "metric_log": metric_log,
}

_MATCHED = (o.PREDICTIONS, o.matched(o.EXPRESSION_GOLD))
_RUNS = "v_runs AS (SELECT model, task, seed, avg(score) AS accuracy, count(*) AS n_docs FROM v_matched GROUP BY model, task, seed)"
_TASK_LIST = "[" + ", ".join(f"'{t}'" for t in GRID_TASKS) + "]"
_GRID = f"""v_grid AS (
  SELECT s_suppkey, 'org/base_grpo_still_' || s_name AS model, CAST(seed AS INTEGER) AS seed, task
  FROM supplier, range(10) s(seed), unnest({_TASK_LIST}) t(task))"""
_SCORED = (
    o.ROLLOUTS,
    o.ANSWERS,
    f"v_scored AS (SELECT *, {o.REWARD['format']} AS format, "
    f"({o.REWARD['format']} + coalesce(2 * ({o.REWARD['accuracy']}), 0.0::DOUBLE)) AS reward FROM v_verified)",
)

ORACLES = {
    "match_expr": o.with_ctes(f"SELECT {_KEY_SQL}, model, score FROM v_matched", *_MATCHED),
    "match_latex": o.with_ctes(f"SELECT {_KEY_SQL}, model, score FROM v_matched", o.PREDICTIONS, o.matched(o.LATEX_GOLD)),
    "match_choice": o.with_ctes(
        rf"""SELECT {_KEY_SQL}, model,
       CASE WHEN regexp_extract_all(prediction, 'Answer:\s*\$?([ABCD])\b', 1)[-1]
                 = substr('ABCD', CAST(gold_index + 1 AS INTEGER), 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM v_eval""",
        o.PREDICTIONS,
    ),
    "best_of_golds": o.with_ctes("SELECT doc, model, max(score) AS score FROM v_matched GROUP BY doc, model", *_MATCHED),
    "task_accuracy": o.with_ctes(
        f"SELECT model, task, seed, {o.r('accuracy', 'accuracy')}, n_docs FROM v_runs", *_MATCHED, _RUNS
    ),
    "leaderboard": o.with_ctes(
        f"SELECT model, task, {o.r('avg(accuracy)', 'mean_accuracy')}, {o.r('stddev_samp(accuracy)', 'std_accuracy')}, "
        f"{o.r('max(accuracy)', 'best_accuracy')}, count(*) AS n_seeds FROM v_runs GROUP BY model, task",
        *_MATCHED,
        _RUNS,
    ),
    "best_checkpoint": o.with_ctes(
        f"SELECT base, task, checkpoint, {o.r('m', 'mean_accuracy')} FROM (SELECT *, row_number() OVER "
        "(PARTITION BY base, task ORDER BY m DESC, checkpoint) AS rn FROM (SELECT base, checkpoint, task, avg(a) AS m FROM "
        "(SELECT base, checkpoint, task, seed, avg(score) AS a FROM v_matched GROUP BY base, checkpoint, task, seed) "
        "GROUP BY base, checkpoint, task)) WHERE rn = 1",
        *_MATCHED,
    ),
    "run_grid": o.with_ctes(
        "SELECT replace(model, '/', '_') AS folder, seed || '-0.6-0.95-' || task || '-32768' AS run_key, seed, task, "
        "32768 AS max_new_tokens FROM v_grid",
        _GRID,
    ),
    "pending_runs": o.with_ctes(
        f"""SELECT model, seed, task FROM v_grid g WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey % (SELECT count(*) FROM supplier) = g.s_suppkey
     AND o_orderkey % 10 = g.seed AND {_TASK_LIST}[CAST(o_custkey % 6 + 1 AS INTEGER)] = g.task)""",
        _GRID,
    ),
    "run_keys": """
SELECT o_orderkey, 'org_m' || o_custkey AS folder,
       (o_orderkey % 10) || '-0.6-0.95-aime24-32768'
         || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-None' ELSE '-4096' END
         || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '-nochat' END AS run_key
FROM orders""",
    "result_json_roundtrip": o.with_ctes(
        f"""SELECT r.model, r.task, r.seed, {o.r('accuracy', 'accuracy')},
       {o.r("epoch(t.hi) - epoch(t.lo)", 'total_evaluation_time_seconds')},
       0.6::DOUBLE AS temperature, 'VLLM' AS launcher_type
FROM v_runs r JOIN (SELECT l_returnflag || '/' || l_linestatus AS model, l_linenumber AS seed, min(l_shipdate) AS lo,
                           max(l_shipdate) AS hi FROM lineitem GROUP BY 1, 2) t
  ON t.model = r.model AND t.seed = r.seed""",
        *_MATCHED,
        _RUNS,
    ),
    "completion_log": o.with_ctes(
        f"SELECT step, 'order ' || prompt_id AS prompt, completion, {o.r('reward', 'reward')} "
        f"FROM v_scored WHERE step % {LOG_EVERY} = 0",
        *_SCORED,
    ),
    "metric_log": o.with_ctes(
        f"SELECT run_id, step, {o.r('avg(format)', 'mean_format')}, {o.r('avg(reward)', 'mean_reward')} "
        "FROM v_scored GROUP BY run_id, step",
        *_SCORED,
    ),
}
