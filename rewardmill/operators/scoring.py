"""Rollout scoring: rewards per row, weighted total, and the rows nobody could score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardmill.functions import answers as an
from rewardmill.functions.chat import content_of
from rewardmill.functions.rewards import Reward, RolloutColumns
from rewardmill.functions.text import of_columns
from rewardmill.operators.skew import left_join_unique, with_group_stats

BATCH_KEYS = ("run_id", "step", "process_id")

_TEXT, _LENGTH = "__text", "__length"
_GOLD, _LATEX_GOLD, _ANSWER = "__gold", "__latex_gold", "__answer"
_CORRECT, _GRADED = "__correct", "__correct_or_ungraded"
_MIN, _MAX = "__min_length", "__max_length"

Checker = Callable[[Column, Column], Column]


def completion_text(df: DataFrame, completion: str = "completion") -> Column:
    """Plain text of a completion column, whether text or a list of messages."""
    if isinstance(df.schema[completion].dataType, T.StringType):
        return F.col(completion)
    return content_of(F.get(F.col(completion), F.lit(0)))


def _golds(df: DataFrame, solution: str, gold: str, latex_gold: str) -> DataFrame:
    """Add normalised golds. The any-form gold falls back on what the LaTeX gold lacks.

    Extraction and normalising are projections of their own, so generated code computes each value once. The
    plain form is looked for only where there is no LaTeX gold, and one value is normalised for both.
    """
    latex = df.select("*", of_columns(an.latex_gold, solution).alias("__raw_latex"))
    raw = latex.select("*", F.coalesce(F.col("__raw_latex"), of_columns(an.plain_gold, solution)).alias("__raw"))
    normal = raw.select(*df.columns, F.col("__raw_latex").isNotNull().alias("__is_latex"), of_columns(an.normalise, "__raw").alias(gold))
    return normal.select(*df.columns, F.when(F.col("__is_latex"), F.col(gold)).alias(latex_gold), gold)


def with_answers(df: DataFrame, completion: str = "completion", solution: str = "solution") -> DataFrame:
    """Add ``gold``, ``gold_latex`` and ``answer``, all normalised; NULL when none is found."""
    raw = df.select("*", an.final_answer(completion_text(df, completion)).alias("__raw_answer"))
    answered = raw.withColumn("answer", of_columns(an.normalise, "__raw_answer")).drop("__raw_answer")
    return _golds(answered, solution, "gold", "gold_latex")


def _with_correctness(df: DataFrame, solution: str, checker: Checker | None) -> DataFrame:
    """Verify once; every reward that needs it reads the same two columns."""
    def verdict(gold: Column, answer: Column) -> Column:
        same = of_columns(an.same_answer, _GOLD, _ANSWER)
        if checker is not None:
            same = F.when(same, F.lit(True)).otherwise(checker(gold, answer))
        return (
            F.when(gold.isNull(), F.lit(None).cast("boolean")).when(answer.isNull(), F.lit(False)).otherwise(same)
        )

    # Plain columns keep the comparison in generated code. An expression named more than once is not merged into
    # the projection above it, so each answer is extracted once.
    correct = verdict(F.col(_GOLD), F.col(_ANSWER))

    # The two golds differ only where the gold holds no LaTeX at all.
    return _golds(df, solution, _GOLD, _LATEX_GOLD).select("*", correct.alias(_CORRECT)).select(
        "*",
        F.when(F.col(_LATEX_GOLD).isNull(), F.lit(True))
        .otherwise(F.coalesce(F.col(_CORRECT), F.lit(False)))
        .alias(_GRADED),
    )


def score_rewards(
    rollouts: DataFrame,
    rewards: Sequence[Reward],
    keep: Sequence[str] | None = None,
    batch_keys: Sequence[str] = BATCH_KEYS,
    completion: str = "completion",
    solution: str = "solution",
    checker: Checker | None = None,
    golds: DataFrame | None = None,
    gold_keys: Sequence[str] = ("prompt_id",),
) -> DataFrame:
    """One nullable double column per reward.

    All text work happens in a single map-side projection, and no text is shuffled:
    only ``keep`` columns, numbers and the short extracted answers go further. With
    ``keep=None`` every input column stays. When the golds live in a table of their
    own, one row per ``gold_keys``, pass it as ``golds``; it is joined to the narrow rows.
    """
    names = [r.name for r in rewards]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate reward names in {names}")
    keep = list(rollouts.columns if keep is None else keep)
    needs_answer = any(r.needs_answer for r in rewards)
    needs_batch = any(r.needs_batch for r in rewards)
    columns = RolloutColumns(
        text=F.col(_TEXT),
        length=F.col(_LENGTH),
        correct=F.col(_CORRECT),
        correct_or_ungraded=F.col(_GRADED),
        has_latex_gold=F.col(_LATEX_GOLD).isNotNull(),
        batch_min_length=F.col(_MIN),
        batch_max_length=F.col(_MAX),
        column=F.col,
    )

    # 1. Text to answers, lengths and the rewards that read only the text.
    text = completion_text(rollouts, completion)
    by_text = [r for r in rewards if not r.needs_answer and not r.needs_batch]
    later = [r for r in rewards if r not in by_text]
    carried = dict.fromkeys(keep)
    if needs_batch:
        carried |= dict.fromkeys(batch_keys)
    carried |= dict.fromkeys(i for r in later for i in r.inputs)
    if needs_answer:
        carried |= dict.fromkeys([solution] if golds is None else gold_keys)
    if golds is not None:
        carried = dict.fromkeys(c for c in carried if c not in golds.columns or c in gold_keys)
    prepared = rollouts.withColumn(_TEXT, text).withColumn(_LENGTH, F.length(F.col(_TEXT)))
    answer = [of_columns(an.final_answer, _TEXT).alias("__raw_answer")] if needs_answer else []
    rows = prepared.select(*carried, _LENGTH, *answer, *[r.build(columns).alias(r.name) for r in by_text])
    if needs_answer:
        rows = rows.withColumn(_ANSWER, of_columns(an.normalise, "__raw_answer")).drop("__raw_answer")

    # 2. Answers against golds.
    if golds is not None:
        rows = left_join_unique(rows, golds, gold_keys)
    if needs_answer:
        rows = _with_correctness(rows, solution, checker)
    by_answer = [r for r in later if not r.needs_batch]
    rows = rows.select("*", *[r.build(columns).alias(r.name) for r in by_answer])

    # 3. Lengths against the extremes of their batch.
    by_batch = [r for r in later if r.needs_batch]
    if by_batch:
        done = [r.name for r in rewards if not r.needs_batch]
        inputs = [i for r in by_batch for i in r.inputs]
        narrow = rows.select(*dict.fromkeys([*keep, *batch_keys, *inputs, _LENGTH, _GRADED, *done]))
        bounds = {_MIN: F.min(_LENGTH), _MAX: F.max(_LENGTH)}
        batched = with_group_stats(narrow, batch_keys, bounds)
        rows = batched.select("*", *[r.build(columns).alias(r.name) for r in by_batch])
    return rows.select(*keep, *names)


def weighted_total(names: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted sum of reward columns; a missing reward adds nothing."""
    weights = [1.0] * len(names) if weights is None else list(weights)
    if len(weights) != len(names):
        raise ValueError(f"{len(names)} rewards but {len(weights)} weights")
    total = F.lit(0.0)
    for name, weight in zip(names, weights):
        total = total + F.coalesce(F.col(name) * F.lit(float(weight)), F.lit(0.0))
    return total


def mean_total(names: Sequence[str]) -> Column:
    """Plain mean of reward columns; a missing reward makes the mean missing."""
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total / F.lit(float(len(names)))


def score(
    rollouts: DataFrame,
    rewards: Sequence[Reward],
    weights: Sequence[float] | None = None,
    **options,
) -> DataFrame:
    """``score_rewards`` plus the weighted ``reward`` column."""
    scored = score_rewards(rollouts, rewards, **options)
    return scored.withColumn("reward", weighted_total([r.name for r in rewards], weights))


def score_preset(rollouts: DataFrame, preset, **options) -> DataFrame:
    """Score by a preset of the registry."""
    return score(rollouts, preset.rewards(), preset.weights, **options)


def unscored(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows for which every reward is missing: the quarantine table.

    The partition's number, which a filter cannot be moved across, keeps the test on finished rows. Moved into the
    scoring it would hold a copy of the text work for every mention of a column.
    """
    finished = scored.withColumn("__partition", F.spark_partition_id())
    missing = F.coalesce(*[F.col(n) for n in names]).isNull() & (F.col("__partition") >= 0)
    return finished.filter(missing).drop("__partition")
