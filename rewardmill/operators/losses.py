"""Loss values and policy statistics from stored per-token log-probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.functions import tokens as tk
from rewardmill.operators.skew import join_group_stats


def pad_to_batch(
    df: DataFrame, keys: Sequence[str], left: Sequence[str] = (), right: Sequence[str] = (), value: int = 0
) -> DataFrame:
    """Pad id arrays to the longest of their batch: prompts on the left, completions on the right.

    The widths, one narrow row per batch, go to the wide rows by a join and not
    the wide rows through a window.
    """
    widths = {f"__width_{c}": F.max(F.size(F.col(c))) for c in (*left, *right)}
    sized = join_group_stats(df, keys, widths)
    padded = {c: tk.pad_left(F.col(c), F.col(f"__width_{c}"), value) for c in left}
    padded |= {c: tk.pad_right(F.col(c), F.col(f"__width_{c}"), value) for c in right}
    return sized.select(*[padded[c].alias(c) if c in padded else F.col(c) for c in df.columns])


TOKEN_COLUMNS = ("prompt_ids", "completion_ids", "cur_logps", "ref_logps")


def _without_tokens(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in TOKEN_COLUMNS]


def on_policy_sequences(df: DataFrame, eos: int) -> DataFrame:
    """Per sequence: counted tokens and summed divergence. The token arrays end here.

    Everything that reads an array happens map-side, so that advantages and losses
    shuffle a few numbers per sequence. They do not need the arrays: the ratio of the
    policy to itself is 1, so a sequence's summed loss is ``beta * sum_kl - n * advantage``.
    """
    counted = df.withColumn("n_tokens", tk.masked_length(F.col("completion_ids"), eos))
    kl = tk.token_kl(
        tk.run_of(F.col("cur_logps"), 1, F.col("n_tokens")),
        tk.run_of(F.col("ref_logps"), 1, F.col("n_tokens")),
    )
    return counted.select(*_without_tokens(df), "n_tokens", tk.total(kl).alias("sum_kl"))


def _per_token(total: str) -> Column:
    return F.try_divide(F.col(total), F.col("n_tokens"))


def on_policy_loss(
    sequences: DataFrame,
    keys: Sequence[str] = (),
    scale_rewards: bool = True,
    beta: float = tk.KL_WEIGHT,
    advantage: str = "advantage",
) -> DataFrame:
    """Mean over sequences of their token mean or, unscaled, the mean over all tokens."""
    lossy = sequences.withColumn(
        "sum_loss", F.lit(beta) * F.col("sum_kl") - F.col("n_tokens") * F.col(advantage)
    )
    loss = (
        F.avg(_per_token("sum_loss"))
        if scale_rewards
        else F.try_divide(F.sum("sum_loss"), F.sum("n_tokens"))
    )
    return lossy.groupBy(*keys).agg(
        loss.alias("loss"),
        F.avg(_per_token("sum_kl")).alias("mean_kl"),
        F.avg("n_tokens").alias("completion_length"),
    )


def no_importance_weight() -> Column:
    """The default strategy: every response counts once."""
    return F.lit(1.0)


def off_policy_sequences(df: DataFrame, clip: float = tk.CLIP_RANGE) -> DataFrame:
    """Per sequence: sums over the completion tokens behind the prompt. The token arrays end here.

    A clipped loss is ``-advantage * min(ratio, 1 + clip)`` where the advantage is
    positive and ``-advantage * max(ratio, 1 - clip)`` where it is not. Summing both
    bounds first means the advantage, which needs the minibatch, can come later.
    """
    length = F.greatest(F.size("cur_logps") - F.col("prompt_len"), F.lit(0))
    counted = df.withColumn("n_tokens", length)
    start = F.col("prompt_len") + 1
    runs = counted.withColumn("__cur", tk.run_of(F.col("cur_logps"), start, F.col("n_tokens"))).withColumn(
        "__ref", tk.run_of(F.col("ref_logps"), start, F.col("n_tokens"))
    )
    ratios = runs.withColumn("__ratio", tk.token_ratio(F.col("__cur"), F.col("__ref")))
    ratio = F.col("__ratio")
    return ratios.select(
        *_without_tokens(df),
        "n_tokens",
        tk.total(tk.token_kl(F.col("__cur"), F.col("__ref"))).alias("sum_kl"),
        tk.total(ratio).alias("sum_ratio"),
        tk.total(F.transform(ratio, lambda r: F.least(r, F.lit(1.0 + clip)))).alias("sum_ratio_low"),
        tk.total(F.transform(ratio, lambda r: F.greatest(r, F.lit(1.0 - clip)))).alias("sum_ratio_high"),
        tk.clipped_count(ratio, clip).alias("n_clipped"),
    )


def off_policy_loss(
    sequences: DataFrame,
    keys: Sequence[str] = ("minibatch_id",),
    beta: float = tk.KL_WEIGHT,
    advantage: str = "advantage",
) -> DataFrame:
    """Optimisation statistics of each minibatch from sequences with their advantage."""
    held = F.when(F.col(advantage) >= 0, F.col("sum_ratio_low")).otherwise(F.col("sum_ratio_high"))
    length = F.col("n_tokens") + F.lit(tk.LENGTH_FLOOR)
    sequence_loss = -F.col(advantage) * held / length
    tokens = F.nullif(F.sum("n_tokens"), F.lit(0))
    stats = sequences.groupBy(*keys).agg(
        F.avg(F.col("importance_weight") * sequence_loss).alias("policy_loss"),
        F.avg(F.col("sum_kl") / length).alias("kl_divergence"),
        F.avg("reward").alias("avg_reward"),
        F.avg("importance_weight").alias("avg_importance_weight"),
        F.coalesce(F.sum("sum_ratio") / tokens, F.lit(0.0)).alias("avg_ratio"),
        F.coalesce(F.sum("n_clipped") / tokens, F.lit(0.0)).alias("clip_fraction"),
    )
    return stats.withColumn("loss", F.col("policy_loss") + F.lit(beta) * F.col("kl_divergence"))


STATISTICS = (
    "loss",
    "policy_loss",
    "kl_divergence",
    "avg_reward",
    "avg_importance_weight",
    "avg_ratio",
    "clip_fraction",
)


def mean_statistics(per_minibatch: DataFrame) -> DataFrame:
    """Mean of every optimisation statistic over the steps."""
    return per_minibatch.agg(*[F.avg(s).alias(s) for s in STATISTICS], F.count(F.lit(1)).alias("n_steps"))
