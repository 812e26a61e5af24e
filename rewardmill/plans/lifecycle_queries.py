"""Registered queries: the three runs from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.operators import curation as cu
from rewardmill.operators import evaluation as ev
from rewardmill.operators import losses as ls
from rewardmill.plans import lifecycles as lc
from rewardmill.plans import oracle as o
from rewardmill.plans import token_queries as tq
from rewardmill.plans import views as v
from rewardmill.registry import PRESETS, training_dataset
from rewardmill.sources.datasets import Location, read_training_set

SEED = 42
BATCH = 8


def training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the question set, their lines as completions, to metrics per step."""
    dataset = training_dataset("still")
    raw = read_training_set(spark, dataset.name, lambda *_: Location(f"{sf_dir}/orders.parquet")).select(
        F.col("o_orderkey").alias("prompt_id"),
        F.col("o_orderpriority").alias("question"),
        (F.pmod("o_orderkey", F.lit(50)) + 1).alias("answer"),
    )
    prompts = cu.build_prompts(cu.normalise_dataset(raw, dataset), dataset)
    completions = v.rollouts(spark, sf_dir).drop("solution")
    _, metrics = lc.training_run(prompts, completions, PRESETS["deepscaler"])
    doubles = ["mean_format", "mean_accuracy", "mean_reward", "mean_reward_std"]
    return metrics.select("run_id", "step", *v.rounded(*doubles), "n_unscored", "n_rows")


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs the predictions belong to, but for those of models whose name starts with A."""
    predictions = v.predictions(spark, sf_dir)
    plan = predictions.select("model", "task", "seed").distinct()
    results = plan.filter(F.col("model").startswith("A"))
    board = ev.leaderboard(lc.evaluation_run(plan, results, predictions, "expression"))
    return board.select("model", "task", *v.rounded("mean_accuracy", "std_accuracy"), "n_seeds")


def offpolicy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.token_rows(spark, sf_dir).drop("minibatch_id")
    stats = lc.offpolicy_run(rows, BATCH, SEED, ["vec_id"])
    return stats.select("minibatch_id", *v.rounded(*ls.STATISTICS))


QUERIES = {"training_run": training_run, "evaluation_run": evaluation_run, "offpolicy_run": offpolicy_run}

_COMPLETIONS = o.ROLLOUTS.replace("v_rollouts AS", "v_lines AS")
_JOINED = """v_rollouts AS (
  SELECT l.* EXCLUDE (solution), CASE WHEN o_orderkey IS NOT NULL THEN '$' || (o_orderkey % 50 + 1) || '$' END AS solution
  FROM v_lines l LEFT JOIN orders ON o_orderkey = prompt_id)"""
_SCORED = f"""v_scored AS (
  SELECT *, {o.REWARD['format']} AS format, {o.REWARD['accuracy']} AS accuracy,
         {o.REWARD['format']} + coalesce(2 * ({o.REWARD['accuracy']}), 0.0::DOUBLE) AS reward FROM v_verified),
v_grouped AS (
  SELECT *, stddev_samp(reward) OVER (PARTITION BY run_id, step, prompt_id) AS group_std FROM v_scored)"""
_BATCHED = o.TOKENS.replace(
    "a.vec_id // 8 AS minibatch_id",
    f"(row_number() OVER (ORDER BY md5('{SEED}:' || a.vec_id), a.vec_id) - 1) // {BATCH} AS minibatch_id",
)

ORACLES = {
    "training_run": o.with_ctes(
        f"SELECT run_id, step, {o.r('avg(format)', 'mean_format')}, {o.r('avg(accuracy)', 'mean_accuracy')}, "
        f"{o.r('avg(reward)', 'mean_reward')}, {o.r('avg(group_std)', 'mean_reward_std')}, "
        "count(*) FILTER (WHERE format IS NULL AND accuracy IS NULL) AS n_unscored, count(*) AS n_rows "
        "FROM v_grouped GROUP BY run_id, step",
        _COMPLETIONS,
        _JOINED,
        o.ANSWERS,
        _SCORED,
    ),
    "evaluation_run": o.with_ctes(
        f"SELECT model, task, {o.r('avg(a)', 'mean_accuracy')}, {o.r('stddev_samp(a)', 'std_accuracy')}, "
        "count(*) AS n_seeds FROM (SELECT model, task, seed, avg(score) AS a FROM v_matched "
        "WHERE model NOT LIKE 'A%' GROUP BY model, task, seed) GROUP BY model, task",
        o.PREDICTIONS,
        o.matched(o.EXPRESSION_GOLD),
    ),
    "offpolicy_run": o.with_ctes(
        "SELECT minibatch_id, " + ", ".join(o.r(c, c) for c in ls.STATISTICS) + " FROM v_stats", _BATCHED, tq._OFF
    ),
}
