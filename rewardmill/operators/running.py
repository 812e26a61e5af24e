"""Statistics that are kept up to date: states that merge, and a table of them with one version per batch.

A state is (number, mean, sum of squared deviations, largest value) of one key. New rows change it without the old
rows being read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FIELDS = ("n", "mean", "m2", "best")


def states_of(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One state per key; null values do not count, and a key without any other has a state of zero rows."""
    x = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"),
        F.max(x).alias("best"),
    )


def _both(a: Column, b: Column) -> Column:
    """The state of two disjoint sets of rows."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n"),
        (a["mean"] + apart * share).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
        F.greatest(a["best"], b["best"]).alias("best"),
    )


def merge_states(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One state per key from tables with at most one each; a key's list is no longer than ``tables``."""
    each = [t.select(*keys, F.struct(F.lit(i).alias("i"), F.struct(*FIELDS).alias("s")).alias("state")) for i, t in enumerate(tables)]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    # In the order of the tables, so that a repeated merge gives the same last digits.
    states = F.transform(F.array_sort(F.collect_list("state")), lambda x: x["s"])
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(None).cast("double").alias("best"))
    return rows.groupBy(*keys).agg(F.aggregate(states, zero, _both).alias("state")).select(*keys, "state.*")


def finished(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (null below two values), largest value and number of each key."""
    some = F.col("n") > 0
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return states.select(*keys, F.when(some, F.col("mean")).alias("mean"), deviation.alias("std"), "best", "n")


def _version(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def read_states(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """All states as they were after ``batch``."""
    return spark.read.parquet(_version(path, batch))


def update_states(spark: SparkSession, path: str, fresh: DataFrame, keys: Sequence[str], batch: int) -> None:
    """States after ``batch``: those after ``batch - 1`` merged with ``fresh``, the states of the new rows.

    Batches are numbered from 0 and come in order. Every version is a table of its own, so a repeated batch writes
    what it wrote before and no row counts twice; a batch whose predecessor was never written fails. Its cost is that of the states and the
    new rows. Versions that nobody reads any more may be deleted but for the last.
    """
    tables = [fresh]
    if batch > 0:
        try:
            tables.insert(0, read_states(spark, path, batch - 1))
        except AnalysisException as missing:
            raise ValueError(f"no states after batch {batch - 1} below {path}") from missing
    merge_states(tables, keys).write.mode("overwrite").parquet(_version(path, batch))
