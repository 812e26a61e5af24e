"""Registered query of the spelling variants."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from rewardmill.llm.common import stored, table
from rewardmill.llm.spelling import variant_groups, word_counts


def misspelt(run: str, state: int) -> str:
    """The run less one sign if 31 divides the checksum of ``<id>:<run>`` (``state``: that of ``<id>:``)."""
    h = zlib.crc32(run.encode(), state)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, some of them misspelt, each with its near words, its form and its root."""
    words = stored(word_counts(table(spark, sf_dir, "documents"), misspelt), "words")
    return variant_groups(words)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES: dict[str, str] = {}
