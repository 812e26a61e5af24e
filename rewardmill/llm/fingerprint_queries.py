"""Registered query of the chunk fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rewardmill.llm.chunk_prints import fingerprint_edits
from rewardmill.llm.common import table


def op4_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with their likeness."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op4_chunk_fingerprints": op4_chunk_fingerprints}
ORACLES: dict[str, str] = {}
