"""A training-data pipeline over ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and decides on all its predecessor kept. All but
the last return the columns of ``documents``; the last returns packed token sequences. Further columns, whatever their names, go
through the first four stages unchanged and do not reach the last. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import stored, table
from rewardmill.llm.compression_lang import fit_languages, identify_languages
from rewardmill.llm.mixing import mix
from rewardmill.llm.packing import decompose
from rewardmill.llm.resampling import drawn, select_quality, with_log_weight
from rewardmill.llm.simhash import one_of_each_group
from rewardmill.llm.token_queries import tokenizer_file

#: Share of all tokens that the mixing stage keeps.
MIX_KEEP = 0.7
#: Not the seed of the quality stage: both hash the document id, and one number must not decide twice.
MIX_SEED = 1


#: The columns that stages read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs`` with its other columns under names that no stage uses, and given back as they were."""
    aside = {c: f"carried_{n}" for n, c in enumerate(docs.columns) if c.lower() not in READ}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; those unlike good labelled text go, as do null texts and texts without a word."""
    ratio, _, least = select_quality(docs, table(spark, sf_dir, "labels"))

    def stage(rows: DataFrame) -> DataFrame:
        return with_log_weight(rows, ratio, "weight").filter(drawn(F.col("weight"), F.col("doc_id"), least))

    return carrying(docs, stage)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear from compression; null texts, texts without a letter or with a narrow margin go."""
    languages = fit_languages(docs)
    return carrying(docs, lambda rows: identify_languages(rows, languages).filter(~F.col("rejected")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; null and blank texts are one group."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics; a null is a value of its own."""
    return carrying(docs, lambda rows: mix(rows, MIX_KEEP, seed=MIX_SEED).filter("kept"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two, none across documents."""
    return decompose(docs, tokenizer_file(), end_id=1, longest=2048)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("packing", packing),
]

# Hashed n-gram models, compression and token ids have no SQL form; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every earlier one is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
