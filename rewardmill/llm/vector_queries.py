"""Registered query of the embedding near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rewardmill.llm.common import table
from rewardmill.llm.flat_graph import near_vectors


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all embeddings at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


QUERIES = {"op11_near_vectors": op11_near_vectors}
ORACLES: dict[str, str] = {}
