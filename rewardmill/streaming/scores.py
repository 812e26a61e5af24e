"""Score rollouts as they arrive, and form prompt groups once they are complete."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rewardmill.functions.rewards import Reward
from rewardmill.operators.groups import GROUP_KEYS, with_advantages
from rewardmill.operators.scoring import score
from rewardmill.operators.skew import join_group_stats
from rewardmill.session import freed_after, released_later


def score_stream(rollouts: DataFrame, rewards: Sequence[Reward], weights: Sequence[float], **options) -> DataFrame:
    """Row-wise rewards and their total on a stream. Batch rewards need whole groups."""
    batch = [r.name for r in rewards if r.needs_batch]
    if batch:
        raise ValueError(f"{batch} compare rows of a batch; score them with score_batches")
    return score(rollouts, rewards, weights, **options)


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly-once append of a stream to parquet files."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def completed_groups(
    scored: DataFrame,
    generations: int,
    ts: str = "ts",
    wait: str = "10 minutes",
    keys: Sequence[str] = GROUP_KEYS,
) -> DataFrame:
    """Per prompt group, its statistics once no row of it has come for ``wait``.

    A group is a session of its key: rows less than ``wait`` apart belong together, wherever the hour turns. The
    state per group is an aggregate of fixed size, not its rows. ``is_complete`` tells full groups
    from short and oversized ones. Many open groups do not fit the executors' heap: call ``keyed.use_keyed_state``
    before the query is started. A stream that ends is closed with ``closing.run_to_the_end``; rows
    later than ``wait`` behind the watermark are dropped by Spark.
    """
    return (
        scored.withWatermark(ts, wait)
        .groupBy(F.session_window(ts, wait), *keys)
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.avg("reward").alias("group_mean"),
            F.stddev_samp("reward").alias("group_std"),
        )
        .select(
            *keys,
            "group_size",
            "group_mean",
            "group_std",
            (F.col("group_size") == generations).alias("is_complete"),
        )
    )


def _held(checkpoint: str, slot: int | str) -> str:
    return f"{checkpoint}-held/{slot}"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _note(spark: SparkSession, checkpoint: str, name: str, number: int) -> None:
    spark.range(number, number + 1, numPartitions=1).write.mode("overwrite").parquet(_held(checkpoint, name))


def _noted(spark: SparkSession, checkpoint: str, name: str) -> int | None:
    """The number kept under ``name``; NULL if there is none yet."""
    path = _held(checkpoint, name)
    return spark.read.schema("id bigint").parquet(path).head()[0] if _there(spark, path) else None


def close_batches(spark: SparkSession, checkpoint: str, aside: Callable[[DataFrame, int], None]) -> None:
    """Give ``aside`` the rows that ``score_batches`` still holds, and hold them no longer.

    They come under the negative of the number after the last batch, which no batch has; a call that is repeated gives the same
    rows under the same number. A stream that never had a batch holds nothing: ``aside`` is not called. If the stream
    goes on later, its groups start anew.
    """
    last = _noted(spark, checkpoint, "last")
    if last is None:
        return
    aside(spark.read.parquet(_held(checkpoint, last % 2)).drop("__seen"), -(last + 1))
    _note(spark, checkpoint, "closed", last)


def score_batches(
    rollouts: DataFrame,
    rewards: Sequence[Reward],
    weights: Sequence[float],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    group_keys: Sequence[str] = GROUP_KEYS,
    generations: int | None = None,
    aside: Callable[[DataFrame, int], None] | None = None,
    patience: int = 10,
    **options,
) -> StreamingQuery:
    """Score arriving groups as tables, batch rewards and advantages included.

    ``sink`` gets the scored rows and the batch number; writing by that number makes a repeated batch harmless.

    With ``generations`` a group is scored once it has that many rows; until then its rows are held in a table beside the
    checkpoint. ``aside`` gets, unscored, groups that outgrow it in one batch or have had no new row for
    ``patience`` batches; ``close_batches`` gives it what is held when the stream is over. Rows that come after their
    group was scored are held like a new group. Without ``generations`` every micro-batch is scored
    alone, which is right only for sources that deliver whole groups at a time.
    """
    if generations is not None and aside is None:
        raise ValueError("held groups may stay short: pass aside=")

    def advantages(rows: DataFrame) -> DataFrame:
        return with_advantages(score(rows, rewards, weights, **options), group_keys)

    def run(batch: DataFrame, number: int) -> None:
        # What scoring persists is freed with the batch, or a long stream would fill its executors.
        with freed_after():
            if generations is None:
                sink(advantages(batch), number)
            else:
                run_held(batch, number)

    def run_held(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__seen", F.lit(number))
        if number and _noted(spark, checkpoint, "closed") != number - 1:
            # Two slots in turn: a repeated batch finds what the one before it left.
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(_held(checkpoint, (number - 1) % 2)))
        # Sizes are a partial aggregate of keys; texts meet them in a join, which splits an oversized group over tasks.
        kept = released_later(rows.persist(StorageLevel.MEMORY_AND_DISK))
        sized = join_group_stats(kept, group_keys, {"__size": F.count(F.lit(1)), "__last": F.max("__seen")})
        waits = (F.col("__size") < generations) & (F.col("__last") > number - patience)
        whole = F.col("__size") == generations
        sized.filter(waits).select(*batch.columns, "__seen").write.mode("overwrite").parquet(_held(checkpoint, number % 2))
        _note(spark, checkpoint, "last", number)
        sink(advantages(sized.filter(whole).select(*batch.columns)), number)
        aside(sized.filter(~waits & ~whole).select(*batch.columns), number)

    return (
        rollouts.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
