"""Registered query of the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import table
from rewardmill.llm.mixing import DIMENSIONS, OTHER_TOPIC, TOPICS, mix

KEEP, EXPONENT, SWEEPS, SEED = 0.5, 0.7, 8, 0


def op7_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, sampling probability and decision of every document."""
    rows = mix(table(spark, sf_dir, "documents"), KEEP, EXPONENT, SWEEPS, SEED)
    return rows.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def _oracle() -> str:
    topic = " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    steps = [
        f"""WITH docs AS (
  SELECT doc_id, source, lang, CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM documents
),
cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0
)""",
        f"kept0 AS (SELECT *, tokens * {KEEP} AS kept FROM cells)",
    ]
    for d in DIMENSIONS:
        steps.append(
            f"share_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {EXPONENT}) / sum(pow(sum(tokens), {EXPONENT})) OVER () AS share FROM cells GROUP BY {d})"
        )
    for n in range(SWEEPS * len(DIMENSIONS)):
        d = DIMENSIONS[n % len(DIMENSIONS)]
        steps.append(
            f"""kept{n + 1} AS MATERIALIZED (
  SELECT c.source, c.lang, c.topic, c.tokens,
    least(c.kept * (SELECT {KEEP} * sum(tokens) FROM cells) * s.share / sum(c.kept) OVER (PARTITION BY c.{d}), c.tokens) AS kept
  FROM kept{n} c JOIN share_{d} s ON c.{d} IS NOT DISTINCT FROM s.{d}
)"""
        )
    last = f"kept{SWEEPS * len(DIMENSIONS)}"
    return (
        ",\n".join(steps)
        + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(k.kept / k.tokens, 0), 6) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / pow(16, 13)
    < coalesce(k.kept / k.tokens, 0) AS kept
FROM docs d LEFT JOIN {last} k ON d.source IS NOT DISTINCT FROM k.source AND d.lang IS NOT DISTINCT FROM k.lang AND d.topic = k.topic
"""
    )


QUERIES = {"op7_raked_mixture": op7_raked_mixture}
ORACLES = {"op7_raked_mixture": _oracle()}
