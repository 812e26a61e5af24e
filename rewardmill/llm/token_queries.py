"""Registered queries on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm import packing, token_files
from rewardmill.llm.common import table
from rewardmill.session import scratch_path


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as Simple-8b files, read them back, one digest per document."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=2)
    read = token_files.read_token_files(spark.read.parquet(path))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents as sequences of at most 2048 ids."""
    rows = packing.decompose(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=1, longest=2048)
    return rows.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op2_token_files": op2_token_files, "op8_power_of_two_packing": op8_power_of_two_packing}
ORACLES: dict[str, str] = {}
