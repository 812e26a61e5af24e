"""Streams over keyed state: groups that come out when they are full, windows that come out when they are over.

State is kept per key by ``transformWithState``; event-time timers bring out what nothing more comes
for. Spark drops rows behind the watermark before a stateful operator. Here the operator
gets its event time as a plain column, so every row reaches it; it compares the row with the query's
watermark itself and hands late rows on, marked ``late``. What goes in comes out. Calls to the state
cost far more than rows and are few: one read, one write, and one timer for as long as a group, or a lane of a window, lives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from rewardmill.streaming.closing import THE_END

# Fixed value: the state store that keyed state with lists and timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Runs and metrics of a window in one cell of its state, so that a cell stays small.
KEYS_PER_PART = 2000
_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
# The stores of all partitions on an executor share one bounded memory (500 MB if the session sets no other).
_BOUNDED_KEY = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
_END_MS = int(pd.Timestamp(THE_END, tz="UTC").timestamp() * 1000)


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store for queries that this session starts from now on: state on the executors' disks, in bounded memory.

    Spark's own choice holds all open groups in the heap. A bound set by the user stays.
    """
    spark.conf.set(_STORE_KEY, STORE)
    if spark.conf.get(_BOUNDED_KEY, None) is None:
        spark.conf.set(_BOUNDED_KEY, "true")


def _milliseconds(wait: str) -> int:
    return int(pd.Timedelta(wait).total_seconds() * 1000)


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows with ``event_ms`` (milliseconds of ``ts``), which Spark does not know as the event time that the watermark follows.

    The row that closes a stream moves the watermark and goes no further.
    """
    marked = rows.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    timed = marked.withColumn("event_ms", F.unix_millis("__ts")).drop("__ts")
    return timed.filter(F.coalesce(F.col("event_ms") < _END_MS - 24 * 3600 * 1000, F.lit(True)))


class _Groups(StatefulProcessor):
    """Rows of one group, held until it is full or its timer comes."""

    def __init__(self, schema: StructType, order: list[str], generations: int, wait_ms: int, value: str):
        self.schema, self.generations, self.wait_ms = schema, generations, wait_ms
        names = schema.fieldNames()
        self.order, self.value, self.time = [names.index(c) for c in order], names.index(value), names.index("event_ms")
        self.made = Row(*names[: self.time], "outcome", "group_size", "group_mean", "group_std")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        status = [StructField("full", BooleanType()), StructField("last_ms", LongType()), StructField("held", IntegerType())]
        self.status = handle.getValueState("status", StructType(status))

    def _out(self, rows: list[tuple], outcome: str) -> Iterator[Row]:
        values = [r[self.value] for r in rows if r[self.value] is not None]
        mean = sum(values) / len(values) if values else None
        deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else None
        for r in rows:
            yield self.made(*r[: self.time], outcome, len(rows), mean, deviation)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came, late, mark = [], [], timerValues.getCurrentWatermarkInMs()
        for row in rows:
            (late if row[self.time] is None or row[self.time] < mark else came).append(tuple(row))
        yield from self._out(late, "late")
        if not came:
            return
        came.sort(key=lambda r: [(r[i] is not None, r[i]) for i in self.order])
        status = self.status.get()
        full, last_ms, held = status or (False, 0, 0)
        last_ms = max(last_ms, max(r[self.time] for r in came))
        if not full:
            room = self.generations - held
            if len(came) >= room:
                yield from self._out([*(tuple(r) for r in (self.rows.get() if held else ())), *came[:room]], "complete")
                if held:
                    self.rows.clear()
                full, held, came = True, 0, came[room:]
            else:
                self.rows.appendList(came)
                held, came = held + len(came), []
        yield from self._out(came, "extra")
        self.status.update((full, last_ms, held))
        if status is None:
            self.handle.registerTimer(last_ms + self.wait_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        _, last_ms, held = self.status.get()
        if last_ms + self.wait_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last_ms + self.wait_ms)
            return
        if held:
            yield from self._out([tuple(r) for r in self.rows.get()], "short")
            self.rows.clear()
        self.status.clear()

    def close(self) -> None:
        pass


class _Windows(StatefulProcessor):
    """Sums and numbers of the values of one window's runs and metrics, a lane of them together, until the watermark passes its end.

    A batch adds its own sums to the state as parts, which are merged once, when the window is over: what is held is not
    written again, and the calls to the state are those of a lane, not of each run and metric.
    """

    def __init__(self, width_ms: int, keys: StructType):
        self.width_ms = width_ms
        self.made = Row("run_id", "name", "start_ms", "value", "n_values", "outcome")
        self.sums = to_arrow_schema(StructType([*keys, StructField("n", LongType()), StructField("total", DoubleType())]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", StructType([StructField("part", BinaryType())]))

    def _part(self, sums: list[tuple]) -> bytes:
        columns = [pa.array(cells, f.type) for cells, f in zip(zip(*sums), self.sums)]
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.sums) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.sums))
        return out.getvalue().to_pybytes()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        start = key[0]
        if start is None or start + self.width_ms <= timerValues.getCurrentWatermarkInMs():
            for row in rows:
                yield self.made(row["run_id"], row["name"], start, row["value"], int(row["value"] is not None), "late")
            return
        sums: dict[tuple, tuple] = {}
        for row in rows:
            run, value = (row["run_id"], row["name"]), row["value"]
            n, total = sums.get(run, (0, 0.0))
            sums[run] = (n, total) if value is None else (n + 1, total + value)
        known = self.parts.exists()
        made = [(*run, *held) for run, held in sums.items()]
        self.parts.appendList([(self._part(made[at : at + KEYS_PER_PART]),) for at in range(0, len(made), KEYS_PER_PART)])
        if not known:
            self.handle.registerTimer(start + self.width_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        sums: dict[tuple, tuple] = {}
        for (part,) in self.parts.get():
            for run_id, name, more, added in zip(*(c.to_pylist() for c in pa.ipc.open_stream(part).read_all().columns)):
                n, total = sums.get((run_id, name), (0, 0.0))
                sums[run_id, name] = (n + more, total + added)
        for run, (n, total) in sums.items():
            yield self.made(*run, key[0], total / n if n else None, n, "window")
        self.parts.clear()

    def close(self) -> None:
        pass


def settled_windows(metrics: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", lanes: int = 16) -> DataFrame:
    """Mean and number of values per run, metric and window of a stream, once the watermark has passed the window's end.

    Columns: run_id, name, window_start, value, n_values, outcome. A row whose window is over by then, or that has no time, comes out as it is with
    outcome ``late``, so windows and late rows together are the batch result (weigh ``value`` by ``n_values``). State is kept
    for each window and each of the ``lanes`` to which its runs and metrics are dealt by hash: two numbers for a run and metric
    and a batch that brought values of it. A task holds the runs and metrics of one lane of one window at a time, so more of
    them in a window need more lanes; a checkpoint keeps the number it began with. Call ``use_keyed_state`` before the query is started.
    """
    width_ms = _milliseconds(width)
    start = F.col("event_ms") - F.pmod("event_ms", F.lit(width_ms))
    lane = F.pmod(F.xxhash64("run_id", "name"), F.lit(lanes)).cast("int")
    timed = _timed(metrics, ts, late).select(start.alias("start_ms"), lane.alias("lane"), "run_id", "name", F.col("value").cast("double").alias("value"))
    keys = StructType([timed.schema["run_id"], timed.schema["name"]])
    made = [StructField("value", DoubleType()), StructField("n_values", LongType()), StructField("outcome", StringType())]
    out = StructType([*keys, timed.schema["start_ms"], *made])
    # Partial sums of a batch would need a second stateful operator; rows of one key are summed in the first.
    settled = timed.groupBy("start_ms", "lane").transformWithState(_Windows(width_ms, keys), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return settled.select("run_id", "name", F.timestamp_millis("start_ms").alias("window_start"), "value", "n_values", "outcome")


def settled_groups(
    rows: DataFrame, generations: int, keys: Sequence[str], order: Sequence[str], ts: str = "ts", late: str = "10 minutes", wait: str = "10 minutes", value: str = "reward"
) -> DataFrame:
    """Every row of a stream once, with ``outcome`` and its set's ``group_size``, ``group_mean`` and ``group_std`` of ``value``.

    ``complete``: the first ``generations`` rows of their group (``keys``), out in the batch that brings the last
    of them, whatever time lies between. ``short``: a group with fewer rows once the watermark is ``wait`` past its last row.
    ``extra``: rows that come when their group is full. ``late``: rows more than ``late`` behind the newest
    event of earlier batches, or without a time. Rows of one batch are taken by ``order``. A group's state is at most ``generations`` rows;
    after its timer nothing of it is left, and later rows begin a new group.
    A single row has no deviation. Call ``use_keyed_state`` before the query is started.
    """
    columns = [c for c in rows.columns if c != ts]
    timed = _timed(rows, ts, late).select(*columns, F.col(ts), "event_ms")
    schema = timed.schema
    made = [StructField("outcome", StringType()), StructField("group_size", LongType()), StructField("group_mean", DoubleType()), StructField("group_std", DoubleType())]
    out = StructType([*[f for f in schema.fields if f.name != "event_ms"], *made])
    processor = _Groups(schema, [*order], generations, _milliseconds(wait), value)
    return timed.groupBy(*keys).transformWithState(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
