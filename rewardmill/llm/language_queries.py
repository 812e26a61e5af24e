"""Registered query of the compression classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import table
from rewardmill.llm.compression_lang import fit_languages, identify_languages, is_training


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(is_training(F.col("doc_id"))))
    rows = identify_languages(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_compression_language": op10_compression_language}
ORACLES: dict[str, str] = {}
