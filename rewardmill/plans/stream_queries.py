"""Registered queries: the streaming jobs, run to the end of the given files and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


from rewardmill.plans import oracle as o
from rewardmill.plans import scoring_queries as sq
from rewardmill.plans import views as v
from rewardmill.registry import PRESETS
from rewardmill.session import scratch_path
from rewardmill.streaming import keyed as kd
from rewardmill.streaming import metrics as sm
from rewardmill.streaming import scores as ss
from rewardmill.streaming.closing import run_to_the_end, with_closing

KEY = list(v.ROLLOUT_KEY)
ROW_PRESET = PRESETS["deepscaler"]
GROUP_SIZE = 4
SETTLED_SIZE = 8


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = v.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def _rollout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The whole table arrives as one unsplittable file: its rows are dealt out before the text work.
    lines = _stream(spark, sf_dir, "lineitem").repartition(v.tasks_for(v.table(spark, sf_dir, "lineitem")))
    return v.rollouts(spark, sf_dir, lineitem=lines)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ss.score_stream(
        _rollout_stream(spark, sf_dir), ROW_PRESET.rewards(), ROW_PRESET.weights, keep=KEY
    )
    path = scratch_path(spark, "scored")
    ss.append_to(scored, path, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(path).select(*KEY, *v.rounded(*ROW_PRESET.reward_names, "reward"))


def stream_completed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group statistics in append mode, the last groups brought out when the stream is over."""
    # All groups of the table are open at once.
    kd.use_keyed_state(spark)
    issued = F.timestamp_seconds(F.col("step") * 60)
    scored = ss.score_stream(
        _rollout_stream(spark, sf_dir).withColumn("ts", issued),
        ROW_PRESET.rewards(),
        ROW_PRESET.weights,
        keep=["run_id", "step", "prompt_id", "ts"],
    )
    path, closing, offsets = (scratch_path(spark, n) for n in ("groups", "closing", "offsets"))
    groups = ss.completed_groups(with_closing(scored, closing), GROUP_SIZE)
    run_to_the_end(lambda: ss.append_to(groups, path, offsets), scored, closing)
    return spark.read.parquet(path).select(
        "prompt_id", "group_size", *v.rounded("group_mean", "group_std"), "is_complete"
    )


def stream_batch_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole micro-batches scored with batch rewards and advantages, each written under its number."""
    path = scratch_path(spark, "batches")
    preset = PRESETS["still"]

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = ss.score_batches(
        _rollout_stream(spark, sf_dir),
        preset.rewards(),
        preset.weights,
        sink,
        scratch_path(spark, "offsets"),
        keep=[*KEY, "run_id", "step"],
    )
    query.awaitTermination()
    return spark.read.parquet(path).select(*KEY, *v.rounded("length", "reward", "advantage"))


def stream_metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of every metric, appended when their hour is over, the last ones at the end of the stream."""
    path, closing, offsets = (scratch_path(spark, n) for n in ("windows", "closing", "offsets"))
    metrics = v.metrics(spark, sf_dir, events=_stream(spark, sf_dir, "events"))
    means = sm.windowed_means(with_closing(metrics, closing))
    run_to_the_end(lambda: ss.append_to(means, path, offsets), metrics, closing)
    return spark.read.parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "run_id",
        "name",
        *v.rounded("value"),
        "n_values",
    )


def _deliver(start: Callable[[DataFrame], StreamingQuery], spark: SparkSession, rows: DataFrame, parts: int, part: Column, closing: str) -> None:
    """Write one delivery after another and run the query over each; then close its groups."""
    path = scratch_path(spark, "deliveries")
    spark.createDataFrame([], rows.schema).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    for n in range(parts):
        rows.filter(part == n).write.mode("append").parquet(path)
        start(stream).awaitTermination()
    run_to_the_end(lambda: start(stream), stream, closing)


def stream_settled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the responses to one prompt, in two deliveries: full groups, short ones, and what comes later."""
    kd.use_keyed_state(spark)
    orders = v.table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("response"), F.col("o_totalprice").cast("double").alias("reward"),
        F.timestamp_seconds(F.col("o_orderkey") % 1000).alias("ts"),
    )
    out, offsets, closing = (scratch_path(spark, n) for n in ("settled", "offsets", "closing"))

    def start(stream: DataFrame) -> StreamingQuery:
        groups = kd.settled_groups(with_closing(stream, closing), SETTLED_SIZE, ["prompt_id"], ["response"], late="1 hour")
        return ss.append_to(groups, out, offsets)

    _deliver(start, spark, rows, 2, F.pmod("response", F.lit(2)), closing)
    return spark.read.parquet(out).select("prompt_id", "response", "outcome", "group_size", *v.rounded("group_mean", "group_std"))


def stream_settled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means over three deliveries, the second of old events: windows and late rows together."""
    kd.use_keyed_state(spark)
    # The table is one unsplittable file: its rows are dealt out, so that deliveries are written and read by many tasks.
    metrics = v.metrics(spark, sf_dir, events=v.spread(v.table(spark, sf_dir, "events"))).select("run_id", "name", "ts", "value")
    out, offsets, closing = (scratch_path(spark, n) for n in ("windows", "offsets", "closing"))

    def start(stream: DataFrame) -> StreamingQuery:
        return ss.append_to(kd.settled_windows(with_closing(stream, closing)), out, offsets)

    _deliver(start, spark, metrics, 3, F.pmod(F.crc32(F.col("run_id").cast("string").cast("binary")), F.lit(3)), closing)
    settled = spark.read.parquet(out)
    total, n = F.sum(F.col("value") * F.col("n_values")), F.sum("n_values")
    merged = settled.groupBy("window_start", "run_id", "name").agg((total / F.nullif(n, F.lit(0))).alias("value"), n.alias("n_values"))
    return merged.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "run_id", "name", *v.rounded("value"), "n_values")


QUERIES = {
    "stream_settled_groups": stream_settled_groups,
    "stream_settled_windows": stream_settled_windows,
    "stream_scores": stream_scores,
    "stream_completed_groups": stream_completed_groups,
    "stream_batch_advantages": stream_batch_advantages,
    "stream_metric_windows": stream_metric_windows,
}

_STILL = (
    f"({o.REWARD['length']} + coalesce(2 * ({o.REWARD['accuracy']}), 0.0::DOUBLE))"
)

ORACLES = {
    "stream_settled_groups": f"""
SELECT prompt_id, response, outcome, count(*) OVER g AS group_size, {o.r('avg(reward) OVER g', 'group_mean')},
       {o.r('stddev_samp(reward) OVER g', 'group_std')}
FROM (SELECT *, CASE WHEN size < {SETTLED_SIZE} THEN 'short' WHEN place <= {SETTLED_SIZE} THEN 'complete' ELSE 'extra' END AS outcome,
        CASE WHEN place > {SETTLED_SIZE} THEN delivery ELSE -1 END AS part
      FROM (SELECT o_custkey AS prompt_id, o_orderkey AS response, o_totalprice::DOUBLE AS reward, o_orderkey % 2 AS delivery,
                   count(*) OVER (PARTITION BY o_custkey) AS size,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) AS place FROM orders))
WINDOW g AS (PARTITION BY prompt_id, outcome, part)""",
    "stream_settled_windows": f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS run_id, event_type AS name,
       {o.r('avg(value)', 'value')}, count(value) AS n_values
FROM events GROUP BY 1, 2, 3""",
    "stream_scores": sq.ORACLES["score_preset_format_accuracy"],
    "stream_completed_groups": o.with_ctes(
        f"""SELECT prompt_id, count(*) AS group_size, {o.r('avg(reward)', 'group_mean')},
       {o.r('stddev_samp(reward)', 'group_std')}, count(*) = {GROUP_SIZE} AS is_complete
FROM v_scored GROUP BY prompt_id""",
        *sq._BASE,
    ),
    "stream_batch_advantages": o.with_ctes(
        f"""SELECT {", ".join(KEY)}, {o.r(o.REWARD['length'], 'length')}, {o.r('reward', 'reward')},
       {o.r('(reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 0.0001::DOUBLE)', 'advantage')}
FROM (SELECT *, {_STILL} AS reward FROM v_verified) WINDOW g AS (PARTITION BY prompt_id)""",
        o.ROLLOUTS,
        o.ANSWERS,
    ),
    "stream_metric_windows": f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS run_id, event_type AS name,
       {o.r('avg(value)', 'value')}, count(value) AS n_values
FROM events GROUP BY 1, 2, 3""",
}
