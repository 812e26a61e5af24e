"""Completion logs and metric logs, appended to or replaced by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.operators.groups import every_k_steps
from rewardmill.sources.folders import replace_folders


def _due(rows: DataFrame, every: int) -> DataFrame:
    columns = [c for c in ("step", "prompt", "completion", "reward") if c in rows.columns]
    return every_k_steps(rows, every).select(*columns)


def append_completions(rows: DataFrame, path: str, every: int = 1) -> None:
    """Append ``(step, prompt, completion[, reward])`` of every ``every``-th step."""
    # Rebalancing gives a step's folder few files, and splits a step that is too large for one.
    _due(rows, every).hint("rebalance", "step").write.mode("append").partitionBy("step").parquet(path)


def replace_completions(rows: DataFrame, path: str, every: int = 1) -> None:
    """As ``append_completions``, in place of what the log held of the same steps; a step must come whole."""
    replace_folders(_due(rows, every), path, ["step"], "parquet")


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """All steps so far; a filter on ``step`` prunes folders."""
    return spark.read.parquet(path)


def _long(metrics: DataFrame, evaluation: bool) -> DataFrame:
    name = F.concat(F.lit("eval_"), F.col("name")) if evaluation else F.col("name")
    return metrics.select("run_id", "step", name.alias("name"), "value")


def append_metrics(metrics: DataFrame, path: str, evaluation: bool = False) -> None:
    """Append ``(run_id, step, name, value)``; evaluation names get the ``eval_`` prefix."""
    _long(metrics, evaluation).hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").parquet(path)


def replace_metrics(metrics: DataFrame, path: str, block: int, evaluation: bool = False) -> None:
    """As ``append_metrics``, in place of what the log held of the same blocks of ``block`` steps.

    Steps ``k * block`` up to, not including, ``(k + 1) * block`` of a run are one folder, training and evaluation
    values apart: a block must come whole, other blocks stay. A log is written by one of the two functions, with one ``block``.
    """
    first = F.floor(F.col("step") / F.lit(block)).cast("bigint") * F.lit(block)
    placed = _long(metrics, evaluation).withColumns({"evaluation": F.lit(evaluation), "first_step": first})
    replace_folders(placed, path, ["run_id", "evaluation", "first_step"], "parquet")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All metrics so far, without the columns that only name folders."""
    return spark.read.parquet(path).drop("evaluation", "first_step")


def metrics_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column per metric name; naming them avoids a pass to find them."""
    return long.groupBy("run_id", "step").pivot("name", names).agg(F.avg("value"))
