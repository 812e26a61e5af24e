"""Running metric means over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(
    metrics: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Mean and count per run, metric and window; rows later than ``late`` are dropped from state.

    Works the same on a table and on a stream.
    """
    timed = metrics.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        timed.withWatermark(ts, late)
        .groupBy(F.window(ts, width), "run_id", "name")
        .agg(F.avg("value").alias("value"), F.count("value").alias("n_values"))
        .select(F.col("window.start").alias("window_start"), "run_id", "name", "value", "n_values")
    )
