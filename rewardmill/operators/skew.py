"""Group statistics and joins with one plan for every size.

Statistics are a partial aggregate, combined before the shuffle, and are joined
back to the rows by key. A key with a third of the table is then a skewed
partition of a join, which adaptive execution splits over tasks; a window would
send all its rows to one. Nothing is run or measured while a plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.session import released_later


def _require_keys(keys: Sequence[str]) -> None:
    if not keys:
        raise ValueError("an empty key list would put the whole table into one group")


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row of a narrow table.

    ``df`` should hold keys and numbers only: it is kept on the executors (spilled to their disks,
    recomputed if one is lost), so that the aggregate and the join compute it once.
    ``session.release`` frees it.
    """
    return join_group_stats(released_later(df.persist(StorageLevel.MEMORY_AND_DISK)), keys, stats)


def join_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row; ``df`` is read twice, the aggregate reads only what it needs."""
    _require_keys(keys)
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return null_safe_join(df, totals, keys, "inner").select(*df.columns, *stats)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key; keeps the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__right_{k}")
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__right_{k}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def left_join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key; two rows of one key fail the job instead of adding rows.

    The check is part of the plan: a partial aggregate of ``right`` by its keys.
    """
    others = [c for c in right.columns if c not in keys]
    several = F.raise_error(F.concat(F.lit("several rows for one key of "), F.lit(", ".join(keys))))
    whole = F.struct(*[F.col(c) for c in others])
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(whole).alias("__row"))
    checked = one.select(*keys, F.when(F.col("__n") == 1, F.col("__row")).otherwise(several.cast(one.schema["__row"].dataType)).alias("__row"))
    return left.join(checked, list(keys), "left").select(*left.columns, *[F.col("__row")[c].alias(c) for c in others])
