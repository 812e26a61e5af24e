"""Registered queries: token masks, divergences, ratios and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.functions import tokens as tk
from rewardmill.operators import groups as gr
from rewardmill.operators import losses as ls
from rewardmill.plans import oracle as o
from rewardmill.plans import views as v


def _joined(ids: Column) -> Column:
    return F.array_join(ids, ",")


def token_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("completion_ids")
    return v.token_rows(spark, sf_dir).select(
        "vec_id",
        tk.first_eos(ids, v.EOS).cast("bigint").alias("eos_index"),
        _joined(tk.completion_mask(ids, v.EOS)).alias("mask"),
        _joined(tk.after_prompt_mask(ids, F.col("prompt_len"))).alias("after_prompt"),
    )


def completion_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.token_rows(spark, sf_dir).select(
        "step", tk.masked_length(F.col("completion_ids"), v.EOS).alias("n_tokens")
    )
    return rows.groupBy("step").agg(
        F.avg("n_tokens").alias("completion_length"), F.count(F.lit(1)).alias("n_rows")
    ).select("step", *v.rounded("completion_length"), "n_rows")


def truncate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of up to 16 ids cut to 12 and completions cut at their end, padded per step."""
    ids = F.col("completion_ids")
    rows = v.token_rows(spark, sf_dir).select(
        "vec_id",
        "step",
        tk.left_truncate(F.slice(ids, F.lit(1), F.col("prompt_len")), 12).alias("prompt_ids"),
        F.slice(ids, F.lit(1), tk.masked_length(ids, v.EOS)).alias("completion_ids"),
    )
    padded = ls.pad_to_batch(rows, ["step"], left=["prompt_ids"], right=["completion_ids"], value=-1)
    return padded.select("vec_id", _joined(F.concat("prompt_ids", "completion_ids")).alias("input_ids"))


def seq_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.slice("cur_logps", F.col("prompt_len") + 1, F.greatest(F.size("cur_logps") - F.col("prompt_len"), F.lit(0)))
    return v.token_rows(spark, sf_dir).select("vec_id", tk.total(run).alias("seq_logprob")).select(
        "vec_id", *v.rounded("seq_logprob")
    )


def _on_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = ls.on_policy_sequences(v.token_rows(spark, sf_dir), v.EOS)
    return gr.with_advantages(sequences, ["minibatch_id"])


def kl_per_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ls.on_policy_sequences(v.token_rows(spark, sf_dir), v.EOS)
    per_token = rows.withColumn("mean_kl", F.col("sum_kl") / F.col("n_tokens"))
    return per_token.select("vec_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), *v.rounded("sum_kl", "mean_kl"))


def surrogate_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio and clipped loss of every token, with the label's distance from 4.5 as advantage."""
    rows = v.token_rows(spark, sf_dir).withColumn("advantage", F.col("reward") - F.lit(4.5))
    ratio = tk.token_ratio(F.col("cur_logps"), F.col("ref_logps"))
    tokens = rows.withColumn("ratio", ratio).withColumn(
        "loss", tk.clipped_surrogate(F.col("ratio"), F.col("advantage"))
    )
    return tokens.select(
        "vec_id", F.posexplode(F.arrays_zip("ratio", "loss")).alias("position", "token")
    ).select("vec_id", "position", F.col("token.ratio").alias("ratio"), F.col("token.loss").alias("loss")).select(
        "vec_id", "position", *v.rounded("ratio", "loss")
    )


def _on_policy_loss(scale: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        loss = ls.on_policy_loss(_on_policy(spark, sf_dir), ["step"], scale)
        return loss.select("step", *v.rounded("loss", "mean_kl", "completion_length"))

    return run


def _off_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = ls.off_policy_sequences(v.token_rows(spark, sf_dir))
    return ls.off_policy_loss(gr.with_batch_advantages(sequences, ["minibatch_id"]), ["minibatch_id"])


def offpolicy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _off_policy(spark, sf_dir).select(
        "minibatch_id", *v.rounded("loss", "policy_loss", "kl_divergence", "avg_reward", "avg_importance_weight")
    )


def clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _off_policy(spark, sf_dir).select("minibatch_id", *v.rounded("avg_ratio", "clip_fraction"))


def offpolicy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.mean_statistics(_off_policy(spark, sf_dir)).select(*v.rounded(*ls.STATISTICS), "n_steps")


QUERIES = {
    "token_mask": token_mask,
    "completion_length": completion_length,
    "truncate_pad": truncate_pad,
    "seq_logprob": seq_logprob,
    "kl_per_sequence": kl_per_sequence,
    "surrogate_per_token": surrogate_per_token,
    "onpolicy_loss_seq": _on_policy_loss(True),
    "onpolicy_loss_token": _on_policy_loss(False),
    "offpolicy_loss": offpolicy_loss,
    "clip_stats": clip_stats,
    "offpolicy_statistics": offpolicy_statistics,
}

_KL = "exp(ref_logps[i] - cur_logps[i]) - (ref_logps[i] - cur_logps[i]) - 1"
_ON = f"""v_on AS (
  SELECT *, list_sum(list_transform(range(1, n_tokens + 1), lambda i: {_KL})) AS sum_kl,
         (reward - avg(reward) OVER (PARTITION BY minibatch_id))
           / (stddev_samp(reward) OVER (PARTITION BY minibatch_id) + 0.0001::DOUBLE) AS advantage
  FROM v_masked),
v_loss AS (SELECT *, 0.04::DOUBLE * sum_kl - n_tokens * advantage AS sum_loss FROM v_on)"""
_OFF = f"""v_off AS (
  SELECT *, reward - avg(reward) OVER (PARTITION BY minibatch_id) AS advantage, range(prompt_len + 1, size + 1) AS idx
  FROM v_masked),
v_sums AS (
  SELECT *, len(idx) AS n,
         list_sum(list_transform(idx, lambda i: -least(exp(cur_logps[i] - ref_logps[i]) * advantage,
           greatest(0.9::DOUBLE, least(exp(cur_logps[i] - ref_logps[i]), 1.1::DOUBLE)) * advantage))) AS sum_loss,
         list_sum(list_transform(idx, lambda i: {_KL})) AS sum_kl,
         list_sum(list_transform(idx, lambda i: exp(cur_logps[i] - ref_logps[i]))) AS sum_ratio,
         len(list_filter(idx, lambda i: exp(cur_logps[i] - ref_logps[i]) > 1.1::DOUBLE
                                     OR exp(cur_logps[i] - ref_logps[i]) < 0.9::DOUBLE)) AS n_clipped
  FROM v_off),
v_batches AS (
  SELECT minibatch_id, avg(importance_weight * (sum_loss / (n + 1e-12::DOUBLE))) AS policy_loss,
         avg(sum_kl / (n + 1e-12::DOUBLE)) AS kl_divergence, avg(reward) AS avg_reward,
         avg(importance_weight) AS avg_importance_weight, sum(sum_ratio) / sum(n) AS avg_ratio,
         sum(n_clipped) / sum(n) AS clip_fraction
  FROM v_sums GROUP BY minibatch_id),
v_stats AS (SELECT *, policy_loss + 0.04::DOUBLE * kl_divergence AS loss FROM v_batches)"""


def _sql(select: str, *ctes: str) -> str:
    return o.with_ctes(select, o.TOKENS, *ctes)


ORACLES = {
    "token_mask": _sql(
        """SELECT vec_id, CASE WHEN eos_at > 0 THEN eos_at - 1 ELSE size END AS eos_index,
       array_to_string(list_transform(range(1, size + 1), lambda i: CASE WHEN i <= n_tokens THEN 1 ELSE 0 END), ',') AS mask,
       array_to_string(list_transform(range(1, size + 1), lambda i: CASE WHEN i <= prompt_len THEN 0 ELSE 1 END), ',') AS after_prompt
FROM v_masked"""
    ),
    "completion_length": _sql(
        f"SELECT step, {o.r('avg(n_tokens)', 'completion_length')}, count(*) AS n_rows FROM v_masked GROUP BY step"
    ),
    "truncate_pad": _sql(
        """SELECT vec_id, array_to_string(list_concat(list_concat(list_transform(range(pmax - len(p)), lambda i: -1), p),
                  list_concat(c, list_transform(range(cmax - len(c)), lambda i: -1))), ',') AS input_ids
FROM (SELECT *, max(len(p)) OVER (PARTITION BY step) AS pmax, max(len(c)) OVER (PARTITION BY step) AS cmax
      FROM (SELECT vec_id, step, completion_ids[greatest(prompt_len - 11, 1):prompt_len] AS p,
                   completion_ids[1:n_tokens] AS c FROM v_masked))"""
    ),
    "seq_logprob": _sql(
        f"SELECT vec_id, {o.r('list_sum(cur_logps[prompt_len + 1:])', 'seq_logprob')} FROM v_masked"
    ),
    "kl_per_sequence": _sql(
        f"SELECT vec_id, n_tokens, {o.r('sum_kl', 'sum_kl')}, {o.r('sum_kl / n_tokens', 'mean_kl')} FROM v_on", _ON
    ),
    "surrogate_per_token": _sql(
        f"""SELECT vec_id, position, {o.r('ratio', 'ratio')},
       {o.r('-least(ratio * a, greatest(0.9::DOUBLE, least(ratio, 1.1::DOUBLE)) * a)', 'loss')}
FROM (SELECT vec_id, i - 1 AS position, exp(cur_logps[i] - ref_logps[i]) AS ratio, reward - 4.5::DOUBLE AS a
      FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM v_masked))"""
    ),
    "onpolicy_loss_seq": _sql(
        f"SELECT step, {o.r('avg(sum_loss / n_tokens)', 'loss')}, {o.r('avg(sum_kl / n_tokens)', 'mean_kl')}, "
        f"{o.r('avg(n_tokens)', 'completion_length')} FROM v_loss GROUP BY step",
        _ON,
    ),
    "onpolicy_loss_token": _sql(
        f"SELECT step, {o.r('sum(sum_loss) / sum(n_tokens)', 'loss')}, {o.r('avg(sum_kl / n_tokens)', 'mean_kl')}, "
        f"{o.r('avg(n_tokens)', 'completion_length')} FROM v_loss GROUP BY step",
        _ON,
    ),
    "offpolicy_loss": _sql(
        "SELECT minibatch_id, "
        + ", ".join(o.r(c, c) for c in ("loss", "policy_loss", "kl_divergence", "avg_reward", "avg_importance_weight"))
        + " FROM v_stats",
        _OFF,
    ),
    "clip_stats": _sql(
        f"SELECT minibatch_id, {o.r('avg_ratio', 'avg_ratio')}, {o.r('clip_fraction', 'clip_fraction')} FROM v_stats",
        _OFF,
    ),
    "offpolicy_statistics": _sql(
        "SELECT " + ", ".join(o.r(f"avg({c})", c) for c in ls.STATISTICS) + ", count(*) AS n_steps FROM v_stats", _OFF
    ),
}
