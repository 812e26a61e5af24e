"""Merge the responses of several workers and attach the dataset's columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.operators.losses import no_importance_weight
from rewardmill.operators.skew import left_join_unique


def union_workers(per_worker: Sequence[DataFrame]) -> DataFrame:
    """One table from one table per worker; ``worker_id`` is the position unless present."""
    tagged = [
        df if "worker_id" in df.columns else df.withColumn("worker_id", F.lit(i))
        for i, df in enumerate(per_worker)
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def aggregated_set(
    responses: DataFrame, importance_weight: Callable[[], Column] = no_importance_weight
) -> DataFrame:
    """(prompt, completion, reward, importance_weight, worker_id) of all workers."""
    return responses.select(
        "prompt", "completion", "reward", importance_weight().alias("importance_weight"), "worker_id"
    )


def flatten_completions(
    responses: DataFrame, completions: str = "completions", along: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per completion from list-valued responses.

    ``along`` names further lists, as {list column: value column}, whose values travel with the completions;
    by default a list column ``rewards`` gives ``reward``. A row whose lists differ in length
    fails the job. Rows with a null or empty list of completions give none.
    """
    lists_of = {name for name, kind in responses.dtypes if kind.startswith("array<")}
    along = {"rewards": "reward"} if along is None and "rewards" in lists_of else dict(along or {})
    lists = [completions, *along]
    others = [c for c in responses.columns if c not in lists]
    uneven = [F.size(F.coalesce(F.col(c), F.array())) != F.size(completions) for c in along]
    zipped = F.arrays_zip(*lists)
    for differs in uneven:
        zipped = F.when(differs, F.raise_error(F.lit("lists of one response differ in length")).cast(responses.select(F.arrays_zip(*lists).alias("z")).schema["z"].dataType)).otherwise(zipped)
    rows = responses.filter(F.col(completions).isNotNull()).withColumn("__one", F.explode(zipped))
    return rows.select(*others, F.col("__one")[completions].alias("completion"), *[F.col("__one")[c].alias(v) for c, v in along.items()])


def first_row_per_prompt(dataset: DataFrame, row_id: str, prompt: str = "prompt") -> DataFrame:
    """The first dataset row of every prompt. A partial aggregate: repeated prompts combine map-side."""
    others = [c for c in dataset.columns if c not in (prompt, "completion")]
    first = dataset.groupBy(prompt).agg(F.min_by(F.struct(*others), F.col(row_id)).alias("__first"))
    return first.select(prompt, *[F.col("__first")[c].alias(c) for c in others])


def attach_first_match(
    responses: DataFrame, dataset: DataFrame, row_id: str, prompt: str = "prompt"
) -> DataFrame:
    """Add the columns of the first dataset row with the response's prompt; NULL when there is none."""
    return left_join_unique(responses, first_row_per_prompt(dataset, row_id, prompt), [prompt])
