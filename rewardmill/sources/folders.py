"""Tables laid out in folders by key, and writes to them that can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def replace_folders(rows: DataFrame, path: str, keys: Sequence[str], fmt: str, **options: str) -> None:
    """Write ``rows`` into one folder per key, in place of what these folders held; others stay as they are.

    Spark stages the files and moves them when the whole job has succeeded, so a lost executor or a job that is run
    again neither doubles rows nor leaves half a folder. Rows are rebalanced by key: a folder gets few files, and
    one that is too large for a task is split.
    """
    placed = rows.hint("rebalance", *keys)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(*keys).format(fmt).save(path)
