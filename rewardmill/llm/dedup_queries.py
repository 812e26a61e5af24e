"""Registered query of the SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import stored, table
from rewardmill.llm.simhash import fingerprints, near_duplicate_groups


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and their components at two or fewer differing bits."""
    prints = stored(fingerprints(table(spark, sf_dir, "documents"), size=3), "simhash")
    groups = near_duplicate_groups(prints, radius=2)
    shown = F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0"))
    return groups.select("doc_id", shown.alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_components": op6_simhash_components}
ORACLES: dict[str, str] = {}
