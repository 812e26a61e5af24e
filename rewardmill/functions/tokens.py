"""Token-level expressions over arrays of ids and log-probabilities.

A completion mask is always one unbroken run of positions, so a run is kept as
(start, length) and values are sliced to it; masks as arrays exist for output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP_RANGE = 0.1
KL_WEIGHT = 0.04
LENGTH_FLOOR = 1e-12


def left_truncate(ids: Column, keep: int) -> Column:
    """The last ``keep`` ids."""
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - F.lit(keep - 1)), F.lit(keep))


def first_eos(ids: Column, eos: int) -> Column:
    """Zero-based position of the first end-of-sequence id; the array's size if there is none."""
    at = F.array_position(ids, eos).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(ids))


def masked_length(ids: Column, eos: int) -> Column:
    """How many ids count: up to and including the first end-of-sequence id."""
    return F.least(first_eos(ids, eos) + 1, F.size(ids))


def run_mask(length: Column, total: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), length), F.array_repeat(F.lit(0), total - length))


def completion_mask(ids: Column, eos: int) -> Column:
    return run_mask(masked_length(ids, eos), F.size(ids))


def after_prompt_mask(ids: Column, prompt_length: Column) -> Column:
    """Mask by prompt length: 0 over the prompt, 1 over everything behind it."""
    prompt = F.least(prompt_length, F.size(ids))
    return F.concat(F.array_repeat(F.lit(0), prompt), F.array_repeat(F.lit(1), F.size(ids) - prompt))


def attention_mask(prompt_length: Column, prompt_width: Column, completion_ids: Column, eos: int) -> Column:
    """Mask of a prompt padded on the left to ``prompt_width``, followed by its completion's."""
    padding = F.greatest(prompt_width - prompt_length, F.lit(0))
    prompt = F.concat(F.array_repeat(F.lit(0), padding), F.array_repeat(F.lit(1), prompt_length))
    return F.concat(prompt, completion_mask(completion_ids, eos))


def pad_left(ids: Column, width: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0))), ids)


def pad_right(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0))))


def run_of(values: Column, start: Column | int, length: Column) -> Column:
    """``length`` values from one-based ``start``: the masked part of an array."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(values, start, length)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def token_kl(current: Column, reference: Column) -> Column:
    """Per-token estimate of the divergence from the reference policy; never negative."""
    return F.zip_with(current, reference, lambda c, r: F.exp(r - c) - (r - c) - F.lit(1.0))


def token_ratio(current: Column, reference: Column) -> Column:
    return F.zip_with(current, reference, lambda c, r: F.exp(c - r))


def clipped_surrogate(ratio: Column, advantage: Column, clip: float = CLIP_RANGE) -> Column:
    """Per-token policy loss with the ratio held within ``1 ± clip`` where that costs reward."""
    def loss(rho: Column) -> Column:
        held = F.greatest(F.lit(1.0 - clip), F.least(rho, F.lit(1.0 + clip)))
        return -F.least(rho * advantage, held * advantage)

    return F.transform(ratio, loss)


def clipped_count(ratio: Column, clip: float = CLIP_RANGE) -> Column:
    return F.size(F.filter(ratio, lambda rho: (rho > 1.0 + clip) | (rho < 1.0 - clip)))
