"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). The tokens to keep
in each cell are raked: scaled to the target share of each source, then of each
language, then of each topic, sweep after sweep, and never above what the cell
holds. A document is then sampled with the probability of its cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import stored

DIMENSIONS = ("source", "lang", "topic")
# First mark found in a text names its topic.
TOPICS = (("table", " | "), ("legal", "icense"), ("web", "http"), ("contact", "@"))
OTHER_TOPIC = "prose"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """Name of the first rule of ``TOPICS`` whose mark the text holds, else ``prose``; null text too."""
    found = F.lit(OTHER_TOPIC)
    for name, mark in reversed(TOPICS):
        found = F.when(F.contains(text, F.lit(mark)), F.lit(name)).otherwise(found)
    return found


def _key(name: str) -> Column:
    """A value as a string that is never null: a null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def tempered_shares(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Target (value, share): the tokens of each value to the power ``exponent``; below 1 lifts the small ones.

    Shares need not add up to one; raking scales them.
    """
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n"))
    return sums.select("value", F.pow(F.col("n").cast("double"), F.lit(exponent)).alias("share"))


def given_shares(target: DataFrame) -> DataFrame:
    """A caller's table (value, share) as a target: values become cell keys, a null value means the rows without one.

    A value named twice gets the sum of its shares; a null share is none.
    """
    sums = target.groupBy(_key("value").alias("value")).agg(F.sum(F.col("share").cast("double")).alias("share"))
    return sums.filter("share > 0")


def count_cells(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Tokens of every cell of ``docs`` (with a column ``tokens``); the dimensions become string keys."""
    keyed = docs.select(*[_key(d).alias(d) for d in dimensions], "tokens")
    return keyed.groupBy(*dimensions).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], keep: float, sweeps: int = 8) -> DataFrame:
    """``cells`` with ``probability``: raked tokens over held tokens, at most 1.

    ``targets`` has a table (value, share) for each dimension; a value without a share gets none.
    ``keep`` is the share of all tokens to keep. Every sweep scales to each dimension in turn and is written
    to the shared folder. Cells are as many as there are combinations of values, not documents;
    their sums are partial aggregates, joined back. Targets that the tokens cannot meet (a share
    larger than what its values hold) are met as far as they go.
    """
    keyed = {}
    for d, target in targets.items():
        present = cells.select(F.col(d).alias("value")).distinct().join(target, "value").filter("share > 0")
        total = present.agg(F.sum("share")).head()[0]
        keyed[d] = stored(present.select(F.col("value").alias(d), (F.col("share") / F.lit(total or 1.0)).alias("share")), "shares")
    held = cells.agg(F.sum("tokens")).head()[0] or 0
    budget = keep * held
    rows = cells.withColumn("kept", F.col("tokens") * F.lit(float(keep)))
    for _ in range(sweeps):
        for d in targets:
            sums = rows.groupBy(d).agg(F.sum("kept").alias("sum")).join(keyed[d], d, "left")
            scale = sums.select(d, F.when(F.col("sum") > 0, F.lit(budget) * F.coalesce("share", F.lit(0.0)) / F.col("sum")).otherwise(0.0).alias("scale"))
            rows = rows.join(scale, d).withColumn("kept", F.least(F.col("kept") * F.col("scale"), F.col("tokens").cast("double"))).drop("scale")
        rows = stored(rows, "cells")
    return rows.withColumn("probability", F.col("kept") / F.col("tokens")).drop("kept")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id; rows that repeat an id share it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(
    docs: DataFrame, keep: float, exponent: float = 0.7, sweeps: int = 8, seed: int = 0, targets: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source, lang, ...) with topic, tokens, probability and kept.

    ``targets`` has a table (value, share) for any of source, lang and topic; shares need not add up to one, and documents
    of a value without a share are left out. The other targets are the tempered shares of the documents' own values. A document without words
    belongs to a cell but weighs nothing: if its cell has no tokens at all its probability is 0. Columns of
    the four names are replaced. Texts are read twice and not shuffled unless the cells outgrow
    Spark's broadcast limit; hot cells are then split by adaptive execution.
    """
    if unknown := set(targets or {}) - set(DIMENSIONS):
        raise ValueError(f"targets for {sorted(unknown)}; known: {DIMENSIONS}")
    rows = docs.drop("topic", "tokens", "probability", "kept").withColumns({"topic": topic_of(F.col("text")), "tokens": word_count(F.col("text"))})
    cells = stored(count_cells(rows), "cells")
    given = targets or {}
    shares = {d: given_shares(given[d]) if d in given else tempered_shares(cells, d, exponent) for d in DIMENSIONS}
    raked = rake(cells, shares, keep, sweeps).select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], "probability")
    same = [_key(d) == F.col(f"cell_{d}") for d in DIMENSIONS]
    found = rows.join(raked, same[0] & same[1] & same[2], "left").drop(*[f"cell_{d}" for d in DIMENSIONS])
    found = found.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return found.withColumn("kept", uniform(F.col("doc_id"), seed) < F.col("probability"))
