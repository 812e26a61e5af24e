"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import rewardmill
from rewardmill.llm.tokens import forget
from rewardmill.session import drop_scratch, scratch_path

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(rewardmill.__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package; a cluster gets it as any other code."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


Batches = Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]


def give_back() -> None:
    """Give the memory that this process has freed back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def given_back(function: Batches, encodes: bool = False) -> Batches:
    """``function`` for a worker that lives on after its task: what it freed does not stay with it, nor do remembered
    words (see ``tokens``) while it does other work than encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        if not encodes:
            forget()
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_batches(df: DataFrame, function: Batches, schema: str | StructType, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` in workers that keep no memory between tasks but, if it ``encodes``, remembered words."""
    ship(df.sparkSession)
    return df.mapInArrow(given_back(function, encodes), schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: one computation, a short lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def superseded(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: their successors are written."""
    for df in tables:
        drop_scratch(df.sparkSession, {os.path.dirname(f) for f in df.inputFiles()})


#: Bits of a membership map: at most 2^19 rows of 64 bits, whatever it is made of.
MAP_BITS = 1 << 25


def map_of(keys: DataFrame, key: str) -> DataFrame:
    """A bounded map of the hashes ``key`` (bigint) of a table, for ``maybe_in``: (word, bits)."""
    place = F.pmod(F.col(key), F.lit(MAP_BITS))
    return keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits"))


def maybe_in(rows: DataFrame, key: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose hash ``key`` may be in the map ``members``, and those whose hash is surely not.

    The map has a fixed largest size, so it can be sent to every task. Where it fills up, more rows are only
    called possible; an exact join of the first part must follow.
    """
    marked = rows.select(F.struct("*").alias("row"), key.alias("key"))
    known = F.broadcast(members.select(F.col("word").alias("known_word"), "bits"))
    joined = marked.join(known, F.shiftright(F.pmod("key", F.lit(MAP_BITS)), 6) == F.col("known_word"), "left")
    hit = F.coalesce(F.expr("getbit(bits, cast(pmod(key, 64) as int)) = 1"), F.lit(False))
    return joined.filter(hit).select("row.*"), joined.filter(~hit).select("row.*")


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_bytes`` of text; a longer text stays whole."""
    ends = utf8(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + max_bytes, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array and their bounds in it; a null text is an empty one."""
    texts = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, "u1"), bounds - bounds[0]
    return np.frombuffer(data, "u1")[bounds[0] : bounds[-1]], bounds - bounds[0]
