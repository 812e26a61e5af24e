"""Registered queries: answers, rewards, presets, advantages, metrics, workers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.functions import rewards as rw
from rewardmill.operators import groups as gr
from rewardmill.operators import scoring as sc
from rewardmill.operators import workers as wk
from rewardmill.plans import oracle as o
from rewardmill.plans import views as v
from rewardmill.registry import PRESETS

KEY = list(v.ROLLOUT_KEY)
GROUP_SIZE = 4
_KEY_SQL = ", ".join(KEY)


def extract_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.with_answers(v.rollouts(spark, sf_dir)).select(*KEY, "gold", "gold_latex", "answer")


def _single(name: str, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reward = rw.reward_named(name, **params)
        scored = sc.score_rewards(v.rollouts(spark, sf_dir), [reward], keep=KEY)
        return scored.select(*KEY, *v.rounded(reward.name))

    return run


def reward_repetition_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.spread(v.table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("completion"))
    scored = sc.score_rewards(docs, [rw.repetition_penalty()], keep=["doc_id"])
    return scored.select("doc_id", *v.rounded("repetition_penalty"))


def reward_steps_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.spread(v.table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("completion"))
    scored = sc.score_rewards(docs, [rw.reasoning_steps(), rw.format_tags(), rw.tag_count()], keep=["doc_id"])
    return scored.select("doc_id", *v.rounded("reasoning_steps", "format", "tag_count"))


def _preset(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        preset = PRESETS[name]
        scored = sc.score_preset(v.rollouts(spark, sf_dir), preset, keep=KEY)
        return scored.select(*KEY, *v.rounded(*preset.reward_names, "reward"))

    return run


def score_offpolicy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewards = [rw.accuracy(), rw.format_tags()]
    scored = sc.score_rewards(v.rollouts(spark, sf_dir), rewards, keep=KEY)
    return scored.withColumn("reward", sc.mean_total(["accuracy", "format"])).select(*KEY, *v.rounded("reward"))


def user_reward_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts stay in Arrow's buffers: as Python objects, batch after batch, they make a worker's memory grow with its rows.
    @F.arrow_udf("double")
    def brevity(text: pa.Array, target: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        share = pc.subtract(1.0, pc.divide(pc.cast(pc.utf8_length(text), "float64"), pc.cast(target, "float64")))
        return pc.if_else(pc.greater_equal(share, 0.0), share, None)

    reward = rw.user_reward("brevity", brevity, "target_length")
    scored = sc.score(v.rollouts(spark, sf_dir), [reward, rw.format_tags()], [2.0, 1.0], keep=KEY)
    return scored.select(*KEY, *v.rounded("brevity", "reward"))


def supplied_score_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewards = [rw.supplied_score("model_score"), rw.format_tags()]
    scored = sc.score(v.rollouts(spark, sf_dir), rewards, [1.0, 0.5], keep=KEY)
    return scored.select(*KEY, *v.rounded("reward"))


def quarantine_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = [*KEY, "completion", "solution"]
    scored = sc.score_rewards(v.rollouts(spark, sf_dir), [rw.accuracy()], keep=keep)
    return sc.unscored(scored, ["accuracy"]).select(*keep)


def cadence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.every_k_steps(v.rollouts(spark, sf_dir), 10).select(*KEY, "step", F.length("completion").alias("len"))


def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.incomplete_groups(v.rollouts(spark, sf_dir), GROUP_SIZE).select("prompt_id", "group_size")


def complete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.complete_groups_only(v.rollouts(spark, sf_dir), GROUP_SIZE).select(*KEY, "solution")


def _scored(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return sc.score_preset(v.rollouts(spark, sf_dir), PRESETS["deepscaler"], keep=[*KEY, *extra])


def _advantages(scale: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = gr.with_advantages(_scored(spark, sf_dir, "run_id", "step"), scale=scale)
        return rows.select(*KEY, *v.rounded("reward", "group_mean", "group_std", "advantage"))

    return run


def advantages_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gr.with_batch_advantages(_scored(spark, sf_dir, "step", "worker_id"), ["step", "worker_id"])
    return rows.select(*KEY, *v.rounded("baseline", "advantage"))


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gr.with_advantages(_scored(spark, sf_dir, "run_id", "step"))
    metrics = gr.step_metrics(rows, ["format", "accuracy"])
    doubles = ["mean_format", "mean_accuracy", "mean_reward", "mean_reward_std"]
    return metrics.select("run_id", "step", *v.rounded(*doubles), "unscored_accuracy", "n_unscored", "n_rows")


def log_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = gr.log_points(v.metrics(spark, sf_dir), 1000, evaluation=True)
    return points.select("run_id", "log_point", "name", *v.rounded("value"), "n_values")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sc.score_rewards(
        v.rollouts(spark, sf_dir), [rw.accuracy()], keep=["prompt_id", "worker_id", "completion"]
    )
    return scored.select(
        F.concat(F.lit("order "), F.col("prompt_id").cast("string")).alias("prompt"),
        "completion",
        F.col("accuracy").alias("reward"),
        "worker_id",
    )


def worker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.worker_summary(_responses(spark, sf_dir)).select("worker_id", "n_responses", *v.rounded("mean_reward"))


def aggregated_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of three workers put together. Each takes its rows before they are scored, so the text is scored once and none is kept."""
    rows = _responses(spark, sf_dir)
    merged = wk.union_workers([rows.filter(F.col("worker_id") == w) for w in range(3)])
    return wk.aggregated_set(merged).select(
        "prompt", F.length("completion").alias("len"), *v.rounded("reward", "importance_weight"), "worker_id"
    )


def aggregated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = gr.aggregated_summary(wk.aggregated_set(_responses(spark, sf_dir)))
    return summary.select("n_samples", *v.rounded("mean_reward", "mean_importance_weight"))


def attach_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-valued responses of every order to the prompt of its first part's name."""
    dataset = v.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("prompt"), F.col("p_brand").alias("solution"), "p_size"
    )
    orders = v.table(spark, sf_dir, "orders")
    names = v.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    asked = orders.withColumn("p_partkey", F.col("o_custkey") * 2).join(names, "p_partkey", "left")
    responses = asked.select(
        "o_orderkey",
        F.coalesce("prompt", F.lit("unknown prompt")).alias("prompt"),
        F.array("o_orderstatus", "o_orderpriority").alias("completions"),
    )
    matched = wk.attach_first_match(wk.flatten_completions(responses), dataset, "p_partkey")
    return matched.select("o_orderkey", "prompt", "completion", "p_partkey", "solution", "p_size")


QUERIES = {
    "extract_answers": extract_answers,
    "reward_accuracy": _single("accuracy"),
    "reward_format": _single("format"),
    "reward_tag_count": _single("tag_count"),
    "reward_reasoning_steps": _single("reasoning_steps"),
    "reward_length": _single("length"),
    "reward_l1_exact": _single("length_l1_exact"),
    "reward_l1_max": _single("length_l1_max"),
    "reward_cosine": _single("cosine"),
    "reward_repetition": _single("repetition_penalty"),
    "reward_repetition_documents": reward_repetition_documents,
    "reward_steps_documents": reward_steps_documents,
    "score_preset_format_accuracy": _preset("deepscaler"),
    "score_preset_format_cosine": _preset("open_rs3"),
    "score_preset_length_accuracy": _preset("still"),
    "score_preset_seven": _preset("open_r1"),
    "score_preset_format_only": _preset("open_rs3_format_ablation"),
    "score_preset_l1_exact": _preset("l1_exact"),
    "score_preset_l1_max": _preset("l1_max"),
    "score_preset_offpolicy": _preset("offpolicy"),
    "score_offpolicy_mean": score_offpolicy_mean,
    "user_reward_udf": user_reward_udf,
    "supplied_score_reward": supplied_score_reward,
    "quarantine_unscored": quarantine_unscored,
    "cadence_rows": cadence_rows,
    "incomplete_groups": incomplete_groups,
    "complete_groups": complete_groups,
    "advantages_scaled": _advantages(True),
    "advantages_unscaled": _advantages(False),
    "advantages_batch": advantages_batch,
    "step_metrics": step_metrics,
    "log_window_metrics": log_window_metrics,
    "worker_summary": worker_summary,
    "aggregated_set": aggregated_set,
    "aggregated_summary": aggregated_summary,
    "attach_first_match": attach_first_match,
}


def _reward_sql(name: str, expression: str | None = None) -> str:
    return o.with_ctes(
        f"SELECT {_KEY_SQL}, {o.r(expression or o.REWARD[name], name)} FROM v_verified", o.ROLLOUTS, o.ANSWERS
    )


def _preset_sql(name: str, long: bool = False) -> str:
    """Rewards and weighted total of a preset."""
    preset = PRESETS[name]
    rules = {n: o.REWARD["cosine_long" if n == "cosine" and long else n] for n in preset.reward_names}
    total = " + ".join(
        f"coalesce({w}::DOUBLE * ({rules[n]}), 0.0::DOUBLE)" for n, w in zip(preset.reward_names, preset.weights)
    )
    columns = ", ".join([o.r(rule, n) for n, rule in rules.items()] + [o.r(total, "reward")])
    ctes = [o.ROLLOUTS, o.ANSWERS]
    source = "v_verified"
    if "repetition_penalty" in rules:
        ctes.append(o.grams_of("v_verified"))
        source = "v_grams"
    return o.with_ctes(f"SELECT {_KEY_SQL}, {columns} FROM {source}", *ctes)


_TOTAL = f"({o.REWARD['format']} + coalesce(2 * ({o.REWARD['accuracy']}), 0.0::DOUBLE))"
_SCORED = f"v_scored AS (SELECT *, {o.REWARD['format']} AS format, {o.REWARD['accuracy']} AS accuracy, {_TOTAL} AS reward FROM v_verified)"
_GROUPED = """v_grouped AS (
  SELECT *, avg(reward) OVER (PARTITION BY prompt_id) AS group_mean,
         stddev_samp(reward) OVER (PARTITION BY prompt_id) AS group_std FROM v_scored)"""
_BASE = (o.ROLLOUTS, o.ANSWERS, _SCORED)


def _advantage_sql(expression: str) -> str:
    columns = ", ".join(
        [o.r(c, c) for c in ("reward", "group_mean", "group_std")] + [o.r(expression, "advantage")]
    )
    return o.with_ctes(f"SELECT {_KEY_SQL}, {columns} FROM v_grouped", *_BASE, _GROUPED)


_DOCS = "v_docs AS (SELECT doc_id, text AS completion FROM documents)"

ORACLES = {
    "extract_answers": o.with_ctes(f"SELECT {_KEY_SQL}, gold, gold_latex, answer FROM v_answers", o.ROLLOUTS, o.ANSWERS),
    **{
        f"reward_{short}": _reward_sql(name)
        for short, name in (
            ("accuracy", "accuracy"),
            ("format", "format"),
            ("tag_count", "tag_count"),
            ("reasoning_steps", "reasoning_steps"),
            ("length", "length"),
            ("l1_exact", "length_l1_exact"),
            ("l1_max", "length_l1_max"),
            ("cosine", "cosine"),
        )
    },
    "reward_repetition": o.with_ctes(
        f"SELECT {_KEY_SQL}, {o.r(o.REWARD['repetition_penalty'], 'repetition_penalty')} FROM v_grams",
        o.ROLLOUTS,
        o.grams_of("v_rollouts"),
    ),
    "reward_repetition_documents": o.with_ctes(
        f"SELECT doc_id, {o.r(o.REWARD['repetition_penalty'], 'repetition_penalty')} FROM v_grams",
        _DOCS,
        o.grams_of("v_docs"),
    ),
    "reward_steps_documents": o.with_ctes(
        "SELECT doc_id, "
        + ", ".join(o.r(o.REWARD[n], n) for n in ("reasoning_steps", "format", "tag_count"))
        + " FROM v_docs",
        _DOCS,
    ),
    "score_preset_format_accuracy": _preset_sql("deepscaler"),
    "score_preset_format_cosine": _preset_sql("open_rs3", long=True),
    "score_preset_length_accuracy": _preset_sql("still"),
    "score_preset_seven": _preset_sql("open_r1", long=True),
    "score_preset_format_only": _preset_sql("open_rs3_format_ablation"),
    "score_preset_l1_exact": _preset_sql("l1_exact"),
    "score_preset_l1_max": _preset_sql("l1_max"),
    "score_preset_offpolicy": _preset_sql("offpolicy"),
    "score_offpolicy_mean": _reward_sql("reward", f"({o.REWARD['accuracy']} + {o.REWARD['format']}) / 2"),
    "user_reward_udf": o.with_ctes(
        f"SELECT {_KEY_SQL}, {o.r('b', 'brevity')}, "
        f"{o.r('coalesce(2 * b, 0.0::DOUBLE) + ' + o.REWARD['format'], 'reward')} "
        "FROM (SELECT *, CASE WHEN length(completion) <= target_length "
        "THEN 1.0::DOUBLE - length(completion) / target_length::DOUBLE END AS b FROM v_rollouts)",
        o.ROLLOUTS,
    ),
    "supplied_score_reward": o.with_ctes(
        f"SELECT {_KEY_SQL}, {o.r('model_score + 0.5::DOUBLE * ' + o.REWARD['format'], 'reward')} FROM v_rollouts",
        o.ROLLOUTS,
    ),
    "quarantine_unscored": o.with_ctes(
        f"SELECT {_KEY_SQL}, completion, solution FROM v_rollouts WHERE solution = ''", o.ROLLOUTS
    ),
    "cadence_rows": o.with_ctes(
        f"SELECT {_KEY_SQL}, step, length(completion) AS len FROM v_rollouts WHERE step % 10 = 0", o.ROLLOUTS
    ),
    "incomplete_groups": f"SELECT l_orderkey AS prompt_id, count(*) AS group_size FROM lineitem GROUP BY 1 HAVING count(*) <> {GROUP_SIZE}",
    "complete_groups": o.with_ctes(
        f"SELECT {_KEY_SQL}, solution FROM v_rollouts WHERE prompt_id IN "
        f"(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = {GROUP_SIZE})",
        o.ROLLOUTS,
    ),
    "advantages_scaled": _advantage_sql("(reward - group_mean) / (group_std + 0.0001::DOUBLE)"),
    "advantages_unscaled": _advantage_sql("reward - group_mean"),
    "advantages_batch": o.with_ctes(
        f"SELECT {_KEY_SQL}, {o.r('b', 'baseline')}, {o.r('reward - b', 'advantage')} FROM "
        "(SELECT *, avg(reward) OVER (PARTITION BY step, worker_id) AS b FROM v_scored)",
        *_BASE,
    ),
    "step_metrics": o.with_ctes(
        f"SELECT run_id, step, {o.r('avg(format)', 'mean_format')}, {o.r('avg(accuracy)', 'mean_accuracy')}, "
        f"{o.r('avg(reward)', 'mean_reward')}, {o.r('avg(group_std)', 'mean_reward_std')}, "
        "count(*) FILTER (WHERE accuracy IS NULL) AS unscored_accuracy, "
        "count(*) FILTER (WHERE accuracy IS NULL AND format IS NULL) AS n_unscored, count(*) AS n_rows "
        "FROM v_grouped GROUP BY run_id, step",
        *_BASE,
        _GROUPED,
    ),
    "log_window_metrics": f"SELECT user_id AS run_id, event_id // 1000 AS log_point, 'eval_' || event_type AS name, "
    f"{o.r('avg(value)', 'value')}, count(value) AS n_values FROM events GROUP BY user_id, event_id // 1000, event_type",
    "worker_summary": o.with_ctes(
        f"SELECT worker_id, count(*) AS n_responses, {o.r('avg(accuracy)', 'mean_reward')} FROM v_scored GROUP BY worker_id",
        *_BASE,
    ),
    "aggregated_set": o.with_ctes(
        f"SELECT 'order ' || prompt_id AS prompt, length(completion) AS len, {o.r('accuracy', 'reward')}, "
        "1.0::DOUBLE AS importance_weight, worker_id FROM v_scored",
        *_BASE,
    ),
    "aggregated_summary": o.with_ctes(
        f"SELECT count(*) AS n_samples, {o.r('avg(accuracy)', 'mean_reward')}, "
        "1.0::DOUBLE AS mean_importance_weight FROM v_scored",
        *_BASE,
    ),
    "attach_first_match": """
WITH v_asked AS (
  SELECT o_orderkey, coalesce(p_name, 'unknown prompt') AS prompt, unnest([o_orderstatus, o_orderpriority]) AS completion
  FROM orders LEFT JOIN part ON p_partkey = o_custkey * 2),
v_first AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)
SELECT o_orderkey, prompt, completion, p.p_partkey, p.p_brand AS solution, p.p_size
FROM v_asked LEFT JOIN v_first f ON f.p_name = prompt LEFT JOIN part p ON p.p_partkey = f.p_partkey""",
}
