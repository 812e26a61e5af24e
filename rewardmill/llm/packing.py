"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: full
pieces of ``longest`` ids, then the binary digits of the rest, largest first.
Every piece is a sequence of its own, so none crosses documents and none is
padded; sequences of one length form a bucket, from which batches are drawn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import map_batches, pieces
from rewardmill.llm.tokens import encoder

#: Bytes of text encoded at a time: larger pieces take more of a worker's memory, which it keeps.
PIECE = 1 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def piece_lengths(n: int, longest: int) -> list[int]:
    """Lengths of a document's pieces in order; their sum is ``n``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048) -> DataFrame:
    """Sequences of ``docs``: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset.

    ``longest`` is a power of two. ``ids`` is binary, little-endian unsigned 32-bit; a null text is an empty
    one, and a document of it is one piece that holds the end id. ``bucket`` is log2 of the length. No row
    moves between tasks, so a repeated id or a hot source costs nothing, and a null id is kept.
    ``sequence_id`` is unique; it follows the order in which the input's parts are read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                ids, counts = coder.encode(part.column("text"))
                raw, read = ids.tobytes(), 0
                end = np.array([end_id], "<u4").tobytes()
                columns: list[list] = [[], [], [], [], []]
                for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    whole = raw[4 * read : 4 * (read + n)] + end
                    read, start = read + n, 0
                    for length in piece_lengths(n + 1, longest):
                        for column, value in zip(columns, (doc_id, start, length, n + 1, whole[4 * start : 4 * (start + length)])):
                            column.append(value)
                        start += length
                arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "ids"])

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), cut, SCHEMA, encodes=True)
    return rows.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(sequences: DataFrame, path: str) -> None:
    """One folder per length, for a loader that draws each batch from one bucket.

    Rows are rebalanced by bucket, and Spark splits a bucket that is too large for one task.
    """
    sequences.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)
