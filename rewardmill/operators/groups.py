"""Statistics over groups of rollouts: advantages, completeness, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.operators.skew import null_safe_join, with_group_stats

STD_FLOOR = 1e-4
# A group is what one step of one run generated for a prompt.
GROUP_KEYS = ("run_id", "step", "prompt_id")


def with_advantages(
    scored: DataFrame,
    keys: Sequence[str] = GROUP_KEYS,
    reward: str = "reward",
    scale: bool = True,
) -> DataFrame:
    """Add ``group_mean``, ``group_std`` (sample) and ``advantage``.

    A group of one row has no sample deviation: its scaled advantage is NULL.
    """
    stats = {"group_mean": F.avg(reward), "group_std": F.stddev_samp(reward)}
    grouped = with_group_stats(scored, keys, stats)
    centred = F.col(reward) - F.col("group_mean")
    advantage = centred / (F.col("group_std") + F.lit(STD_FLOOR)) if scale else centred
    return grouped.withColumn("advantage", advantage)


def with_batch_advantages(
    scored: DataFrame, keys: Sequence[str] = ("minibatch_id",), reward: str = "reward"
) -> DataFrame:
    """Advantage against the mean of the whole minibatch, whatever prompts it mixes."""
    grouped = with_group_stats(scored, keys, {"baseline": F.avg(reward)})
    return grouped.withColumn("advantage", F.col(reward) - F.col("baseline"))


def check_generations(batch_rows: int, processes: int, generations: int) -> None:
    """The global batch must hold whole groups of at least two rows."""
    total = batch_rows * processes
    valid = [g for g in range(2, total + 1) if total % g == 0]
    if generations not in valid:
        raise ValueError(f"{generations} generations do not divide a global batch of {total}; valid: {valid}")


def incomplete_groups(rollouts: DataFrame, generations: int, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Groups that do not have exactly ``generations`` rows, with their size."""
    sizes = rollouts.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.filter(F.col("group_size") != generations)


def complete_groups_only(
    rollouts: DataFrame, generations: int, keys: Sequence[str] = GROUP_KEYS
) -> DataFrame:
    """Rows of groups with exactly ``generations`` rows."""
    return null_safe_join(rollouts, incomplete_groups(rollouts, generations, keys), keys, "left_anti")


def step_metrics(
    with_advantage: DataFrame,
    reward_names: Sequence[str],
    keys: Sequence[str] = ("run_id", "step"),
    required: str = "reward",
) -> DataFrame:
    """Means per step: each reward over its scored rows, the total, and the group deviation."""
    missing = F.coalesce(*[F.col(n) for n in reward_names]).isNull()
    return with_advantage.groupBy(*keys).agg(
        *[F.avg(n).alias(f"mean_{n}") for n in reward_names],
        *[F.count_if(F.col(n).isNull()).alias(f"unscored_{n}") for n in reward_names],
        F.avg(required).alias("mean_reward"),
        F.avg("group_std").alias("mean_reward_std"),
        F.count_if(missing).alias("n_unscored"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def to_long_metrics(wide: DataFrame, keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """One row per metric name and value."""
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(
        list(keys), [F.col(n).cast("double").alias(n) for n in names], "name", "value"
    )


def log_points(
    metrics: DataFrame, logging_steps: int, evaluation: bool = False, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Mean of each metric between two log points; evaluation logs get the ``eval_`` prefix."""
    name = F.concat(F.lit("eval_"), F.col("name")) if evaluation else F.col("name")
    point = F.floor(F.col("step") / F.lit(logging_steps)).cast("bigint")
    return (
        metrics.select(*keys, point.alias("log_point"), name.alias("name"), "value")
        .groupBy(*keys, "log_point", "name")
        .agg(F.avg("value").alias("value"), F.count("value").alias("n_values"))
    )


def worker_summary(responses: DataFrame) -> DataFrame:
    """Rows and mean reward per worker."""
    return responses.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("n_responses"), F.avg("reward").alias("mean_reward")
    )


def aggregated_summary(aggregated: DataFrame) -> DataFrame:
    """Rows, mean reward and mean importance weight of a merged response set."""
    return aggregated.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("reward").alias("mean_reward"),
        F.avg("importance_weight").alias("mean_importance_weight"),
    )


def every_k_steps(df: DataFrame, k: int, step: str | Column = "step") -> DataFrame:
    """Rows whose step is a multiple of ``k``; prunes partitions when ``step`` is one."""
    step = F.col(step) if isinstance(step, str) else step
    return df.filter(F.pmod(step, F.lit(k)) == 0)
