"""Registered queries: seeded orders, samples, shards, minibatches, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.operators import sampling as sa
from rewardmill.plans import views as v

SEED = 42
SHARDS = 3
BATCH = 32
PROCESSES = 4
KEY = ["o_orderkey"]


def _orders(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return v.table(spark, sf_dir, "orders").select("o_orderkey", *extra)


def repeat_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.repeat_shuffled(_orders(spark, sf_dir), 4, SEED, KEY).select(
        "o_orderkey", "order_rank", F.col("gen_id").cast("bigint").alias("gen_id")
    )


def sample_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.sample_rows(_orders(spark, sf_dir, "o_totalprice"), 64, SEED, KEY)


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.first_rows(_orders(spark, sf_dir, "o_orderstatus"), KEY)


def shard_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.shard_contiguous(_orders(spark, sf_dir), SHARDS, KEY).select("o_orderkey", "order_rank", "shard")


def shard_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.shard_shuffled(_orders(spark, sf_dir), SHARDS, SEED, KEY).select("o_orderkey", "order_rank", "shard")


def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.minibatches(_orders(spark, sf_dir), BATCH, SEED, KEY).select("o_orderkey", "minibatch_id")


def minibatch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many steps as one and a half rounds over the batches."""
    orders = _orders(spark, sf_dir)
    n_batches = -(-orders.count() // BATCH)
    steps = n_batches + n_batches // 2
    return sa.schedule_minibatches(orders, BATCH, steps, SEED, KEY)


def process_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows gathered in process order, and the slice that falls to process 1."""
    rows = _orders(spark, sf_dir, F.pmod("o_custkey", F.lit(PROCESSES)).alias("process_id"))
    per_process = rows.count() // PROCESSES
    return sa.process_slice(rows, 1, per_process, ["process_id", "o_orderkey"])


QUERIES = {
    "repeat_sample": repeat_sample,
    "sample_prompts": sample_prompts,
    "first_rows": first_rows,
    "shard_contiguous": shard_contiguous,
    "shard_shuffled": shard_shuffled,
    "minibatches": minibatches,
    "minibatch_schedule": minibatch_schedule,
    "process_slice": process_slice,
}

_SHUFFLED = f"row_number() OVER (ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey) - 1"
_SHARD = f"CAST(least(order_rank // (SELECT count(*) // {SHARDS} FROM orders), {SHARDS - 1}) AS INTEGER)"

ORACLES = {
    "repeat_sample": "SELECT o_orderkey, order_rank, gen_id FROM "
    f"(SELECT o_orderkey, {_SHUFFLED} AS order_rank FROM orders), range(4) g(gen_id)",
    "sample_prompts": f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('{SEED}:' || o_orderkey), o_orderkey LIMIT 64",
    "first_rows": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100",
    "shard_contiguous": f"SELECT o_orderkey, order_rank, {_SHARD} AS shard FROM "
    "(SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS order_rank FROM orders)",
    "shard_shuffled": f"SELECT o_orderkey, order_rank, {_SHARD} AS shard FROM "
    f"(SELECT o_orderkey, {_SHUFFLED} AS order_rank FROM orders)",
    "minibatches": f"SELECT o_orderkey, ({_SHUFFLED}) // {BATCH} AS minibatch_id FROM orders",
    "minibatch_schedule": f"""
WITH n AS (SELECT CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS n_batches FROM orders),
b AS (
  SELECT o_orderkey, round, n_batches, (row_number() OVER (PARTITION BY round ORDER BY md5('{SEED}:' || round || ':' || o_orderkey), o_orderkey) - 1) // {BATCH} AS minibatch_id
  FROM orders, n, range(2) r(round)
)
SELECT o_orderkey, minibatch_id, round * n_batches + minibatch_id AS step FROM b
WHERE round * n_batches + minibatch_id < n_batches + n_batches // 2""",
    "process_slice": f"""
SELECT o_orderkey, process_id, order_rank FROM (
  SELECT o_orderkey, o_custkey % {PROCESSES} AS process_id,
         row_number() OVER (ORDER BY o_custkey % {PROCESSES}, o_orderkey) - 1 AS order_rank FROM orders)
WHERE order_rank // (SELECT count(*) // {PROCESSES} FROM orders) = 1""",
}
