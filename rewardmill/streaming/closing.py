"""Bring out the last windows of a stream.

Append mode emits a window when later events have moved the watermark past it, so
the last ones wait for events that may never come. A stream that is over gets one
closing row with a far time: ``with_closing`` adds its (still empty) source,
``run_to_the_end`` runs the query, sends the row and runs the query once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: later than any event.
THE_END = "9000-01-01 00:00:00"


def with_closing(stream: DataFrame, path: str) -> DataFrame:
    """``stream`` and whatever closing rows appear under ``path``."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run_to_the_end(start: Callable[[], StreamingQuery], stream: DataFrame, path: str, ts: str = "ts") -> None:
    """Run the query that ``start`` starts until its sources are read, then close all windows.

    Both runs must use one checkpoint. The closing row has NULL everywhere but in ``ts``; its own window never closes.
    """
    start().awaitTermination()
    cells = [(F.lit(THE_END) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    stream.sparkSession.range(1).select(*cells).write.mode("append").parquet(path)
    start().awaitTermination()
