"""The three runs a user starts, each composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rewardmill.operators import evaluation as ev
from rewardmill.operators import groups as gr
from rewardmill.operators import losses as ls
from rewardmill.operators import sampling as sa
from rewardmill.operators import scoring as sc
from rewardmill.registry import Preset


def training_run(
    prompts: DataFrame, completions: DataFrame, preset: Preset, prompt_key: str = "prompt_id"
) -> tuple[DataFrame, DataFrame]:
    """Completions of prepared prompts to (rows with advantages, metrics per step).

    ``prompts`` has one row per prompt. Completions are reduced to answers and numbers
    before their prompt's gold is joined, so their text is never shuffled; adaptive execution
    splits a prompt with a large share of all completions.
    """
    columns = [c for c in ("solution", "target_length") if c in prompts.columns]
    group = ["run_id", "step", prompt_key]
    scored = sc.score_preset(
        completions, preset, keep=group, golds=prompts.select(prompt_key, *columns), gold_keys=[prompt_key]
    )
    rows = gr.with_advantages(scored, group, scale=preset.scale_rewards)
    return rows, gr.step_metrics(rows, preset.reward_names)


def evaluation_run(
    plan: DataFrame,
    results: DataFrame,
    predictions: DataFrame,
    metric: str,
    keys: Sequence[str] = ("model", "task", "seed"),
    overwrite: bool = False,
) -> DataFrame:
    """Predictions of the runs still pending to one accuracy per run."""
    pending = ev.pending_runs(plan, results, keys, overwrite).select(*keys)
    due = predictions.join(pending.distinct(), list(keys), "left_semi")
    return ev.task_accuracy(ev.match(due, metric), keys)


def offpolicy_run(responses: DataFrame, batch_size: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """Merged responses with log-probabilities to the statistics of each shuffled minibatch.

    Token arrays are summed up before the shuffle that forms the minibatches.
    """
    sequences = ls.off_policy_sequences(responses)
    batched = sa.minibatches(sequences, batch_size, seed, row_key)
    return ls.off_policy_loss(gr.with_batch_advantages(batched, ["minibatch_id"]), ["minibatch_id"])
