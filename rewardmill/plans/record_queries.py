"""Registered queries: writes that are repeated, damaged records, kept statistics, rewards over lists, SFT sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.operators import curation as cu
from rewardmill.operators import list_rewards as lr
from rewardmill.operators import running as ru
from rewardmill.plans import evaluation_queries as eq
from rewardmill.plans import oracle as o
from rewardmill.plans import views as v
from rewardmill.registry import SFT_COLUMNS
from rewardmill.session import checkpointed, scratch_path
from rewardmill.sources import logs, results

KEY = list(v.ROLLOUT_KEY)
FIXED_PROMPT = "What is 1 + 1?"
BATCHES = 3
METRIC_BLOCK = 1 << 16


def _order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as the record of a run; customers are models, so some runs were done more than once."""
    runs = v.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("org/m"), F.col("o_custkey").cast("string")).alias("model"),
        F.col("o_orderpriority").alias("task"),
        F.pmod("o_orderkey", F.lit(10)).cast("int").alias("seed"),
        (F.col("o_totalprice") / F.lit(1000000.0)).alias("accuracy"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.pmod("o_orderkey", F.lit(86400))).alias("end_time"),
        F.col("o_orderkey").cast("string").alias("slurm_job_id"),
        F.lit(0.6).alias("temperature"),
        F.lit(0.95).alias("top_p"),
        F.lit(32768).alias("max_new_tokens"),
        F.lit(32768).alias("max_model_length"),
    )
    return results.result_records(runs)


def result_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all events' users by type, written, then half of the runs written again: one record per run."""
    path = scratch_path(spark, "runs")
    users = v.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.avg("value").alias("accuracy"), F.min("ts").cast("timestamp").alias("start_time"), F.max("ts").cast("timestamp").alias("end_time")
    )
    runs = users.select(
        F.lit("org/m").alias("model"), F.col("event_type").alias("task"), F.pmod("user_id", F.lit(16)).cast("int").alias("seed"),
        "accuracy", "start_time", "end_time", F.lit(0.6).alias("temperature"), F.lit(0.95).alias("top_p"),
        F.lit(32768).alias("max_new_tokens"), F.lit(32768).alias("max_model_length"), F.col("user_id").cast("string").alias("slurm_job_id"),
    )
    # Users of one seed are one run: the one that ended last stays, of those the one that began last, then any fixed one.
    last = F.max_by(F.struct(*[c for c in runs.columns]), F.struct("end_time", "start_time", "slurm_job_id"))
    records = results.result_records(runs.groupBy("task", "seed").agg(last.alias("r")).select("r.*"))
    results.replace_results(records, path)
    results.replace_results(records.filter("seed < 8"), path)
    back = results.read_results(spark, path)
    return back.select("task", "seed", "slurm_job_id", (F.round(F.col("results")["extractive_match"], 6) + 0.0).alias("accuracy"))


def result_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all orders as lines, every seventh cut off and every eleventh without its model: each is in one table."""
    path = scratch_path(spark, "lines")
    records = _order_runs(spark, sf_dir)
    order = F.col("slurm_job_id").cast("bigint")
    shown = records.select(order.alias("o"), F.struct("slurm_job_id", F.when(order % 11 != 0, F.col("model")).alias("model"), "task", "seed", "results").alias("r"))
    line = F.to_json("r")
    shown.select(F.when(F.col("o") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    good = results.read_results(spark, path).select(
        F.col("slurm_job_id").cast("bigint").alias("o_orderkey"), "model", (F.round(F.col("results")["extractive_match"], 6) + 0.0).alias("accuracy"),
        F.lit(False).alias("damaged"),
    )
    job = F.regexp_extract("line", '"slurm_job_id":"([0-9]+)"', 1).cast("bigint")
    bad = results.damaged_results(spark, path).select(
        job.alias("o_orderkey"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("accuracy"), F.lit(True).alias("damaged")
    )
    return good.unionByName(bad)


def fixed_prompt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one fixed prompt was answered at every hundredth step, without rewards; the last write of a step stays."""
    path = scratch_path(spark, "fixed")
    rows = v.table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 64").alias("step"), F.lit(FIXED_PROMPT).alias("prompt"),
        F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("completion"),
    )
    logs.replace_completions(rows, path, eq.LOG_EVERY)
    logs.replace_completions(rows.filter("step % 200 = 0").withColumn("completion", F.upper("completion")), path, eq.LOG_EVERY)
    back = logs.read_completions(spark, path)
    return back.select(F.col("step").cast("bigint").alias("step"), "prompt", "completion")


def metric_log_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a step of its priority's run, logged; then the last half of the blocks logged again with other values."""
    path = scratch_path(spark, "metrics")
    rows = v.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("step"), F.lit("price").alias("name"), F.col("o_totalprice").cast("double").alias("value")
    )
    logs.replace_metrics(rows, path, METRIC_BLOCK)
    logs.replace_metrics(rows.withColumn("value", -F.col("value")), path, METRIC_BLOCK, evaluation=True)
    again = rows.filter(F.expr(f"step div {METRIC_BLOCK} % 2 = 1"))
    for _ in range(2):
        logs.replace_metrics(again.withColumn("value", F.col("value") + 1), path, METRIC_BLOCK)
    return logs.read_metrics(spark, path).select("run_id", F.col("step").cast("bigint").alias("step"), "name", *v.rounded("value"))


def leaderboard_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard kept by states, from runs that come in three batches, the second of them twice."""
    keys = ["model", "task"]
    runs = checkpointed(eq._runs(spark, sf_dir))
    path = scratch_path(spark, "states")
    for batch in (0, 1, 1, 2):
        fresh = ru.states_of(runs.filter(F.pmod("seed", F.lit(BATCHES)) == batch), keys, "accuracy")
        ru.update_states(spark, path, fresh, keys, batch)
    board = ru.finished(ru.read_states(spark, path, BATCHES - 1), keys)
    named = board.withColumnsRenamed({"mean": "mean_accuracy", "std": "std_accuracy", "best": "best_accuracy", "n": "n_seeds"})
    return named.select(*keys, *v.rounded("mean_accuracy", "std_accuracy", "best_accuracy"), "n_seeds")


def brevity_rank() -> lr.ListReward:
    """The share of a completion's group that is longer than it; a group is summarised as its sorted distinct lengths and their numbers."""

    def summarise(rows: pd.DataFrame) -> bytes:
        return np.stack(np.unique(rows["length"].to_numpy("i8"), return_counts=True)).tobytes()

    def table(held: bytes) -> np.ndarray:
        return np.frombuffer(held, "i8").reshape(2, -1)

    def merge(parts: list[bytes]) -> bytes:
        lengths, counts = np.concatenate([table(p) for p in parts], axis=1)
        distinct, place = np.unique(lengths, return_inverse=True)
        total = np.zeros(len(distinct), "i8")
        np.add.at(total, place, counts)
        return np.stack([distinct, total]).tobytes()

    def score(rows: pd.DataFrame, summary: bytes | None) -> list[float | None]:
        lengths, counts = table(summary)
        up_to = np.concatenate([[0], np.cumsum(counts)])
        n = up_to[-1]
        longer = n - up_to[np.searchsorted(lengths, rows["length"].to_numpy("i8"), side="right")]
        return [float(x) / (n - 1) if n > 1 else None for x in longer]

    def score_groups(rows: pd.DataFrame, ends: np.ndarray) -> np.ndarray:
        # In order of group and length, all rows of a group behind a row's equals are longer.
        lengths, sizes = rows["length"].to_numpy("i8"), np.diff(ends, prepend=0)
        group = np.repeat(np.arange(len(ends)), sizes)
        order = np.lexsort((lengths, group))
        last = np.ones(len(order), bool)
        last[:-1] = (lengths[order][1:] != lengths[order][:-1]) | (group[order][1:] != group[order][:-1])
        behind = np.flatnonzero(last)[np.cumsum(last) - last] + 1
        longer = np.empty(len(order), "f8")
        longer[order] = ends[group[order]] - behind
        others = np.repeat(sizes - 1, sizes)
        return np.where(others > 0, longer / np.maximum(others, 1), np.nan)

    return lr.ListReward("brevity_rank", score, ["length"], summarise, merge, score_groups)


def reward_group_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completion's rank by length among those of its prompt, as a reward over the whole list."""
    rows = v.rollouts(spark, sf_dir).select(*KEY, F.length("completion").cast("bigint").alias("length"))
    scored = lr.score_lists(rows, brevity_rank(), ["prompt_id"], KEY[1:])
    return scored.select(*KEY, *v.rounded("brevity_rank"))


def sft_pairs_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question pairs in the shape of every SFT source, with the thinking and without.

    The pairs are joined once and every shape is made beside them: a union of a shape each would read the join's
    whole input again for each, and all shapes' parts in one task.
    """
    pairs = v.question_pairs(v.table(spark, sf_dir, "conversations"))
    rows = pairs.select("conv_id", "turn", "question", F.col("solution").alias("__thought"), F.col("answer").alias("__reply"))
    made = []
    for source, (trajectory, attempt) in SFT_COLUMNS.items():
        # A source may show its attempt as the thinking too.
        told = {trajectory: F.col("__thought")} | {attempt: F.concat(F.lit(attempt + ": "), F.col("__reply"))}
        for trace_free in (False, True):
            text = f"__text_{len(made)}"
            shaped = cu.sft_conversations(rows.withColumns(told), source, trace_free)
            rows = cu.render(shaped, "plain", output=text, eos="</s>").drop("messages", *told)
            made.append(F.struct(F.lit(source).alias("source"), F.lit(trace_free).alias("trace_free"), F.col(text).alias("text")))
    return rows.select("conv_id", "turn", F.inline(F.array(*made)))


QUERIES = {
    "result_rerun": result_rerun,
    "result_quarantine": result_quarantine,
    "fixed_prompt_log": fixed_prompt_log,
    "metric_log_rerun": metric_log_rerun,
    "leaderboard_incremental": leaderboard_incremental,
    "reward_group_rank": reward_group_rank,
    "sft_pairs_sources": sft_pairs_sources,
}

_SOURCES = ", ".join(f"('{s}', '{attempt}', {str(trajectory == attempt).lower()})" for s, (trajectory, attempt) in SFT_COLUMNS.items())

ORACLES = {
    "result_rerun": f"""
WITH u AS (SELECT user_id, event_type AS task, user_id % 16 AS seed, avg(value) AS accuracy, min(ts) AS lo, max(ts) AS hi
           FROM events GROUP BY user_id, event_type)
SELECT task, CAST(seed AS INTEGER) AS seed, CAST(user_id AS VARCHAR) AS slurm_job_id, {o.r('accuracy', 'accuracy')} FROM u
QUALIFY row_number() OVER (PARTITION BY task, seed ORDER BY hi DESC, lo DESC, CAST(user_id AS VARCHAR) DESC) = 1""",
    "result_quarantine": f"""
SELECT o_orderkey, CASE WHEN NOT damaged THEN 'org/m' || o_custkey END AS model,
       CASE WHEN NOT damaged THEN {o.r('o_totalprice / 1000000.0::DOUBLE', 'x').removesuffix(' AS x')} END AS accuracy, damaged
FROM (SELECT *, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS damaged FROM orders)""",
    "fixed_prompt_log": f"""
SELECT o_orderkey // 64 AS step, '{FIXED_PROMPT}' AS prompt,
       CASE WHEN o_orderkey // 64 % 200 = 0 THEN upper(o_orderkey || ' ' || o_orderpriority) ELSE o_orderkey || ' ' || o_orderpriority END AS completion
FROM orders WHERE o_orderkey // 64 % {eq.LOG_EVERY} = 0""",
    "metric_log_rerun": f"""
SELECT o_orderpriority AS run_id, o_orderkey AS step, n.name,
       {o.r(f"CASE WHEN n.name = 'eval_price' THEN -o_totalprice WHEN o_orderkey // {METRIC_BLOCK} % 2 = 1 THEN o_totalprice + 1 ELSE o_totalprice END", 'value')}
FROM orders, (VALUES ('price'), ('eval_price')) n(name)""",
    "leaderboard_incremental": eq.ORACLES["leaderboard"],
    "reward_group_rank": o.with_ctes(
        f"SELECT {', '.join(KEY)}, {o.r('longer / nullif(n - 1, 0)::DOUBLE', 'brevity_rank')} FROM ("
        "SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n, "
        "rank() OVER (PARTITION BY prompt_id ORDER BY length(completion) DESC) - 1 AS longer FROM v_rollouts)",
        o.ROLLOUTS,
    ),
    "sft_pairs_sources": f"""
SELECT q.conv_id, q.turn, s.source, f.trace_free,
       '<|user|>' || chr(10) || q.text || '</s>' || chr(10) || '<|assistant|>' || chr(10) || 'think: ' || chr(10)
       || CASE WHEN f.trace_free OR s.one THEN s.attempt || ': ' || a.text ELSE 'because ' || lower(q.text) END
       || chr(10) || ' answer: ' || s.attempt || ': ' || a.text || '</s>' || chr(10) AS text
FROM conversations q JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant',
(VALUES {_SOURCES}) s(source, attempt, one), (VALUES (false), (true)) f(trace_free)""",
}
