"""Registered query of the importance resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import table
from rewardmill.llm.resampling import drawn, select_quality


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance weight of every document, and whether it is drawn."""
    _, weights, least = select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return weights.withColumn("selected", drawn(F.col("log_weight"), F.col("doc_id"), least))


QUERIES = {"op9_importance_resampling": op9_importance_resampling}
ORACLES: dict[str, str] = {}
