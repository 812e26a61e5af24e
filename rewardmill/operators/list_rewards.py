"""Rewards over whole lists of completions: what a row earns depends on the other rows of its group.

Rows reach Python by group, many small groups to a call. A group with more bytes than one task should hold is cut into blocks: each block
gives a summary, summaries are merged ``FAN`` at a time until one is left, and every block is scored with it. So a
group with a third of all rows is shared out over many tasks, and no task sees more than a block and ``FAN`` summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardmill.operators.skew import null_safe_join

#: Bytes of one block, and summaries merged at a time.
BLOCK_BYTES = 32 << 20
FAN = 64


@dataclass(frozen=True)
class ListReward:
    """A reward of a row among its group.

    ``score(rows, summary)`` returns one number (or None: not scored) per row of a pandas frame with ``inputs``. Without
    ``summarise`` and ``merge`` it gets the whole group and None. With them, ``summarise(rows)`` gives the bytes that
    stand for some rows of a group, ``merge(list of bytes)`` those of their union, in any order and grouping, and ``score`` gets
    those of the whole group; ``rows`` may then be a part of it. ``score_groups(rows, ends)``, if given, scores many whole groups
    at once, with the result of ``score`` for each: ``rows`` holds them one after another, ``ends`` where each ends.
    """

    name: str
    score: Callable[[pd.DataFrame, bytes | None], Iterable[float | None]]
    inputs: Sequence[str]
    summarise: Callable[[pd.DataFrame], bytes] | None = None
    merge: Callable[[list[bytes]], bytes] | None = None
    score_groups: Callable[[pd.DataFrame, np.ndarray], Iterable[float | None]] | None = None


def _bytes_of(df: DataFrame, columns: Sequence[str]) -> Column:
    """An estimate of a row's bytes: those of its texts, and some for everything else."""
    size = F.lit(64).cast("bigint")
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif not isinstance(kind, T.NumericType | T.BooleanType | T.DateType | T.TimestampType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def _values(reward: ListReward, rows: pd.DataFrame, summary: bytes | None) -> list[float | None]:
    return _numbers(reward, rows, reward.score(rows, summary)) if len(rows) else []


def _numbers(reward: ListReward, rows: pd.DataFrame, given: Iterable[float | None]) -> list[float | None]:
    values = [None if v is None or v != v else float(v) for v in given]
    if len(values) != len(rows):
        raise ValueError(f"{reward.name} gave {len(values)} scores for {len(rows)} rows")
    return values


def _scored(reward: ListReward, rows: pd.DataFrame, values: list[float | None], kept: Sequence[str]) -> pd.DataFrame:
    return rows[list(kept)].assign(**{reward.name: pd.array(values, dtype="Float64")})


def score_lists(
    df: DataFrame, reward: ListReward, group_keys: Sequence[str], row_key: Sequence[str], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(group keys, row key, reward) of every row; join wide rows to it by key.

    A null in a group key is a value of its own. ``row_key`` tells the rows of a group apart. A group of more than
    ``block_bytes`` fails the job with its size if ``reward`` has no ``merge``; it is never scored in part. Building the
    plan runs one job if it has: the largest number of blocks decides how often summaries are merged, and without one above 1 nothing is.
    """
    clash = {"__bytes", "__blocks", "__block", "__summary", reward.name} & set(df.columns)
    if clash:
        raise ValueError(f"columns that the result or its making needs: {sorted(clash)}")
    kept = list(dict.fromkeys([*group_keys, *row_key]))
    columns = list(dict.fromkeys([*kept, *reward.inputs]))
    rows = df.select(*columns)
    sizes = rows.groupBy(*group_keys).agg(F.sum(_bytes_of(rows, columns)).alias("__bytes"))
    out = T.StructType([*[rows.schema[c] for c in kept], T.StructField(reward.name, T.DoubleType())])
    if reward.merge is None or reward.summarise is None:
        too_large = F.raise_error(F.format_string("a group has %d bytes, more than the bound; give the reward a merge", F.col("__bytes")))
        whole = F.when(F.col("__bytes") > block_bytes, too_large.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        checked = null_safe_join(rows, sizes.select(*group_keys, whole.alias("__block")), group_keys, "inner")
        return checked.groupBy(*group_keys, "__block").applyInPandas(lambda part: _scored(reward, part, _values(reward, part[list(reward.inputs)], None), kept), out)

    blocks = sizes.withColumn("__blocks", F.ceil(F.col("__bytes") / F.lit(block_bytes)))
    most, total = blocks.agg(F.max("__blocks"), F.sum("__bytes")).head()
    if total is None:
        return df.sparkSession.createDataFrame([], out)
    counted = null_safe_join(rows, blocks.select(*group_keys, "__blocks"), group_keys, "inner")
    # Whole groups travel together, many to a call.
    units = max(-(-total // block_bytes), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unit = F.pmod(F.xxhash64(*group_keys), F.lit(units)).alias("__block")

    def whole_groups(part: pd.DataFrame) -> pd.DataFrame:
        group = part.groupby(list(group_keys), dropna=False, sort=False).ngroup().to_numpy()
        ordered = part.iloc[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group))
        read = ordered[list(reward.inputs)]
        if reward.score_groups is not None:
            return _scored(reward, ordered, _numbers(reward, read, reward.score_groups(read, ends)), kept)
        each = [read.iloc[low:high] for low, high in zip([0, *ends[:-1]], ends)]
        return _scored(reward, ordered, [v for rows in each for v in _values(reward, rows, reward.summarise(rows))], kept)

    small = counted.filter("__blocks = 1").select(*columns, unit).groupBy("__block").applyInPandas(whole_groups, out)
    if most == 1:
        return small
    large = blocks.filter("__blocks > 1").select(*group_keys, "__blocks")
    number = F.pmod(F.xxhash64(*row_key), F.col("__blocks")).alias("__block")
    placed = counted.filter("__blocks > 1").select(*columns, number)
    state = T.StructType([*[rows.schema[c] for c in group_keys], T.StructField("__block", T.LongType()), T.StructField("__summary", T.BinaryType())])

    def summarised(part: pd.DataFrame) -> pd.DataFrame:
        first = part[[*group_keys, "__block"]].iloc[:1].copy()
        first["__summary"] = [reward.summarise(part[list(reward.inputs)])]
        return first

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[:1].copy()
        if len(part) > 1:
            first["__summary"] = [reward.merge(list(part["__summary"]))]
        return first

    summaries = placed.groupBy(*group_keys, "__block").applyInPandas(summarised, state)
    while most > 1:
        summaries = summaries.withColumn("__block", F.expr(f"__block div {FAN}")).groupBy(*group_keys, "__block").applyInPandas(merged, state)
        most = -(-most // FAN)
    # The group's summary goes once to each of its blocks.
    sent = null_safe_join(summaries.drop("__block"), large, group_keys, "inner")
    sent = sent.select(*group_keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)).alias("__block"), "__summary")

    def scored(part: pd.DataFrame, summary: pd.DataFrame) -> pd.DataFrame:
        return _scored(reward, part, _values(reward, part[list(reward.inputs)], summary["__summary"].iloc[0] if len(summary) else None), kept)

    where = [*group_keys, "__block"]
    return small.unionByName(placed.groupBy(*where).cogroup(sent.groupBy(*where)).applyInPandas(scored, out))
