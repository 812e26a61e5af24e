"""Seeded shuffles, repeats, samples, shards and minibatches.

A random order is the order of ``md5(seed:row key)``: the same rows come out on
any cluster and after any lost executor. ``row_key`` must identify a row; a
repeated key fails the job.

Ranks are found on the order columns alone: range partitions, as many as Spark makes
of them, sorted in parallel and stored once; one count per partition gives the
offsets. Wide rows are only joined with their ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.functions.text import seeded_key
from rewardmill.operators.skew import left_join_unique
from rewardmill.session import checkpointed


#: Digits of a digest by which one counting pass tells rows apart: 4,096 bins.
DIGITS = 3


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _ranks(keys: DataFrame, order: Sequence[str], output: str) -> tuple[DataFrame, int]:
    """``keys`` with the zero-based rank of every row in the order of ``order``, and the number of rows.

    All of ``keys`` is stored: pass narrow columns. The broadcast table has one row per range partition.
    """
    # monotonically_increasing_id: partition number in the upper bits, row number in the lower 33.
    stored = checkpointed(
        keys.repartitionByRange(*_cols(order)).sortWithinPartitions(*_cols(order)).withColumn("__position", F.monotonically_increasing_id())
    )
    parts = stored.withColumn("__part", F.shiftright("__position", 33).cast("int"))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, seen = [], 0
    for part, n in sorted(map(tuple, sizes)):
        offsets.append((part, seen))
        seen += n
    table = keys.sparkSession.createDataFrame(offsets, "__part int, __offset bigint")
    within = F.col("__position").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = parts.join(F.broadcast(table), "__part").withColumn(output, F.col("__offset") + within)
    return ranked.select(*keys.columns, output), seen


def _ranked(df: DataFrame, keys: DataFrame, order: Sequence[str], row_key: Sequence[str], output: str, keep: Column | None = None):
    """``df`` with its ranks (only those where ``keep`` holds), and the number of rows."""
    ranks, total = _ranks(keys, order, output)
    ranks = ranks.filter(keep) if keep is not None else ranks
    narrow = ranks.select(*row_key, output)
    if set(df.columns) <= set(row_key):
        return narrow.select(*df.columns, output), total
    joined = left_join_unique(df, narrow, row_key)
    return (joined.filter(F.col(output).isNotNull()) if keep is not None else joined), total


def _shuffled(df: DataFrame, seed: int, row_key: Sequence[str], output: str) -> tuple[DataFrame, int]:
    keys = df.select(*row_key, seeded_key(seed, *_cols(row_key)).alias("__key"))
    return _ranked(df, keys, ["__key", *row_key], row_key, output)


def _ordered(df: DataFrame, order: Sequence[str], output: str, keep: Column | None = None) -> tuple[DataFrame, int]:
    return _ranked(df, df.select(*order), order, order, output, keep)


def shuffled_rank(df: DataFrame, seed: int, row_key: Sequence[str], output: str = "order_rank") -> DataFrame:
    """Zero-based rank of every row in the seeded order, without a one-task sort."""
    return _shuffled(df, seed, row_key, output)[0]


def ordered_rank(df: DataFrame, order: Sequence[str], output: str = "order_rank") -> DataFrame:
    """Zero-based rank of every row in the order of ``order``, which must identify a row."""
    return _ordered(df, order, output)[0]


def repeat_shuffled(df: DataFrame, repeats: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """Seeded order with every row ``repeats`` times in a row: ``(order_rank, gen_id)`` is the order."""
    ranked = shuffled_rank(df, seed, row_key)
    return ranked.withColumn("gen_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def _cut(keys: DataFrame, n: int) -> str | None:
    """The shortest prefix up to which exactly ``n`` of the digests in ``key`` lie; None if there are at most ``n``.

    Each pass counts the digests by their next digits, in at most ``16 ** DIGITS`` bins, and goes on in the bin of
    the n-th. Only these counts come to the driver.
    """
    prefix = ""
    while True:
        bins = keys.filter(F.startswith("key", F.lit(prefix))).groupBy(F.substring("key", 1, len(prefix) + DIGITS).alias("bin")).count()
        counts = sorted(map(tuple, bins.collect()))
        if not prefix and sum(held for _, held in counts) <= n:
            return None
        for digits, held in counts:
            if held >= n:
                break
            n -= held
        if held == n:
            return digits
        if digits == prefix:
            raise ValueError("several rows for one key at the end of the sample")
        prefix = digits


def sample_rows(df: DataFrame, n: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """``n`` distinct rows at random, the first of the seeded order; all rows if there are no more.

    The last digest of the sample is found by counting passes over the row keys alone (four or five for 10^12
    rows). What comes back is a filter of ``df``: no rank, no sort, no stored table, no join, no shuffle.
    """
    if n < 1:
        return df.limit(0)
    key = seeded_key(seed, *_cols(row_key))
    cut = _cut(df.select(key.alias("key")), n)
    return df if cut is None else df.filter(F.substring(key, 1, len(cut)) <= cut)


def first_rows(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows of a defined order, for a trial run."""
    return df.orderBy(*order).limit(n)


def _shard_of(rank: Column, total: int, shards: int) -> Column:
    size = total // shards
    last = F.lit(shards - 1)
    if size == 0:
        return last
    return F.least(F.floor(rank / F.lit(size)), last).cast("int")


def shard_contiguous(df: DataFrame, shards: int, order: Sequence[str]) -> DataFrame:
    """Equal contiguous shards in the given order; the last one takes the remainder."""
    ranked, total = _ordered(df, order, "order_rank")
    return ranked.withColumn("shard", _shard_of(F.col("order_rank"), total, shards))


def shard_shuffled(df: DataFrame, shards: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """Equal shards of a seeded shuffle; the last one takes the remainder."""
    ranked, total = _shuffled(df, seed, row_key, "order_rank")
    return ranked.withColumn("shard", _shard_of(F.col("order_rank"), total, shards))


def minibatches(df: DataFrame, size: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """Shuffled minibatches of ``size`` rows; the last one may be short."""
    ranked = shuffled_rank(df, seed, row_key)
    return ranked.withColumn("minibatch_id", F.floor(F.col("order_rank") / F.lit(size)).cast("bigint"))


def schedule_minibatches(df: DataFrame, size: int, steps: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """The key and ``minibatch_id`` of every row in each of ``steps`` optimisation steps.

    When the batches run out, the rows are shuffled anew, by ``md5(seed:round:row key)``, and dealt out again. Join
    the wide rows to the result by ``row_key``.
    """
    keys = df.select(*row_key)
    n = keys.count()
    if not n or steps < 1:
        return keys.filter("false").select("*", F.lit(0).cast("bigint").alias("minibatch_id"), F.lit(0).cast("bigint").alias("step"))
    n_batches = -(-n // size)
    rounds = -(-steps // n_batches)
    each = keys.withColumn("__round", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint"))))
    each = each.withColumn("__key", seeded_key(seed, F.col("__round"), *_cols(row_key)))
    ranked, _ = _ranks(each, ["__round", "__key", *row_key], "__rank")
    batch = F.floor((F.col("__rank") - F.col("__round") * F.lit(n)) / F.lit(size)).cast("bigint")
    step = F.col("__round") * F.lit(n_batches) + F.col("minibatch_id")
    return ranked.withColumn("minibatch_id", batch).withColumn("step", step).filter(F.col("step") < steps).select(*row_key, "minibatch_id", "step")


def process_slice(df: DataFrame, process: int, per_process: int, order: Sequence[str]) -> DataFrame:
    """The rows of one process when all rows, in order, are dealt out in equal slices."""
    low = process * per_process
    mine = (F.col("order_rank") >= low) & (F.col("order_rank") < low + per_process)
    return _ordered(df, order, "order_rank", mine)[0]
