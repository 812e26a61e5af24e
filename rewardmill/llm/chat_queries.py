"""Registered query of the chat windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.chat_windows import budgeted_windows, read_targets, read_turns
from rewardmill.llm.common import table

BUDGET, HISTORY = 1024, 256
# Fixed value: the text of both turns of conversation -7.
TRICKY = "\\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations in windows and read them back: one digest per conversation.

    A conversation's digest needs its bytes in one cell; everything before that works by window.
    """
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    windows = budgeted_windows(turns, BUDGET, HISTORY)
    read = windows.select("conv_id", "window_start", "repeated", F.length("text").alias("chars"), read_turns(F.col("text")).alias("said"), read_targets(F.col("text"), F.col("loss_spans")).alias("targets"))
    new = F.slice("said", F.col("repeated").cast("int") + 1, F.greatest(F.size("said") - F.col("repeated").cast("int"), F.lit(0)))
    parts = read.select(
        "conv_id", "chars", F.size(new).alias("n"), F.struct(
            "window_start",
            F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("targets", "").alias("targets"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts")
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    targets = F.array_join(F.transform("parts", lambda p: p["targets"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars",
    )


_WORDS = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"
QUERIES = {"op1_chat_windows": op1_chat_windows}
ORACLES = {
    "op1_chat_windows": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
),
numbered AS (
  SELECT *, len(regexp_extract_all(text, '{_WORDS}')) + 4 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS of_n,
    30 - 11 + length(replace(regexp_replace(role, '<(/?turn|says)>', '<~\1>', 'g'), '\', '\\'))
      + length(replace(regexp_replace(text, '<(/?turn|says)>', '<~\1>', 'g'), '\', '\\')) + 1 AS chars
  FROM turns
),
marked AS (SELECT *, n = 1 AND role = 'system' AND of_n > 1 AS is_system FROM numbered),
conv AS (
  SELECT conv_id, coalesce(sum(tokens) FILTER (is_system), 0) AS system_tokens, coalesce(sum(chars) FILTER (is_system), 0) AS system_chars
  FROM marked GROUP BY conv_id
),
placed AS (
  SELECT m.conv_id, tokens, chars, system_chars,
    CAST(sum(tokens) OVER (PARTITION BY m.conv_id ORDER BY n) - tokens AS BIGINT) AS place,
    CAST(greatest({BUDGET - HISTORY} - system_tokens, 1) AS BIGINT) AS fresh
  FROM marked m JOIN conv c ON m.conv_id IS NOT DISTINCT FROM c.conv_id WHERE NOT is_system
),
celled AS (SELECT *, fresh - fresh // 4 AS size FROM placed),
cells AS (
  SELECT *, (place + tokens - 1) // size AS cell,
    place // size <> (place + tokens - 1) // size AND tokens > fresh // 4 AS alone
  FROM celled
),
windows AS (
  SELECT conv_id, cell, alone, min(place) AS start, sum(chars) + any_value(system_chars) AS chars FROM cells GROUP BY ALL
),
history AS (
  SELECT w.conv_id, sum(c.chars) AS chars FROM windows w JOIN cells c
    ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.place < w.start AND c.place >= w.start - {HISTORY}
  GROUP BY w.conv_id
),
formatted AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM (SELECT conv_id, chars FROM windows UNION ALL SELECT conv_id, chars FROM history) GROUP BY conv_id
),
digests AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS targets
  FROM marked GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, length(targets) AS loss_chars, sha256(targets) AS loss_sha256, formatted_chars
FROM digests d JOIN formatted f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
}
