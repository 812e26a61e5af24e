"""Registered query of the conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import table
from rewardmill.llm.turn_repair import conversation_key, repair_conversations


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` with the faults that a checksum of conv_id and turn gives each; nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("draw")).filter("draw <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations and repair them: one row per conversation.

    Its audit and the digest of its text need a conversation in one cell; everything before that works by blocks.
    """
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    conv = conversation_key(F.col("conv_id"))
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy(conv.alias("conv")).agg(F.coalesce(gap, F.lit(0)).alias("gaps"))
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    block = F.struct("part", "block", "audit", lines.alias("lines"))
    repaired = repair_conversations(rows).groupBy("conv").agg(*[F.sum(c).alias(c) for c in sums], F.array_sort(F.collect_list(block)).alias("blocks"))
    said = F.array_join(F.flatten(F.transform("blocks", lambda b: b["lines"])), "\n")
    audit = F.array_join(F.transform("blocks", lambda b: b["audit"]), "")
    reports = repaired.select("conv", *sums, audit.alias("audit"), F.sha2(said, 256).alias("repaired_sha256"))
    every = given.select(conv.alias("conv"), "conv_id").distinct()
    whole = every.join(gaps, "conv", "left").join(reports, "conv", "left")
    return whole.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *sums)], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES: dict[str, str] = {}
