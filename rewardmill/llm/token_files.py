"""Token-ID output: word-aligned Simple-8b coding of tokenised documents.

A file set is a folder of Parquet parts written by Spark's committer, so a lost
executor leaves no half-written part and any store that Spark reaches will do.
Its rows are blocks of whole documents in ascending order of their id:

    shard, block        place of the block; ascending (shard, block) is document order
    before              number of ids of its shard before it
    doc_ids             bigint array, in order
    counts              number of ids of each document
    payload             binary, little-endian:
                          uint32 number of ids, uint32 number of words,
                          uint32 for every STRIDE words: number of ids before them,
                          the 64-bit words

A word has a selector in its upper 4 bits and 60 bits of ids. The selector
names how many ids of how many bits it holds (``LAYOUTS``); selector 0 is the
escape: one id of any size up to 60 bits. Decoding is vectorised: the selectors
give every word's first place, and all words of one selector are unpacked by one
shift. The offsets let a reader decode any span of ids without what lies before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import map_batches, pieces
from rewardmill.llm.tokens import encoder

# Ids per word and bits per id for each selector; selector 0 is the escape.
LAYOUTS = ((1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
STRIDE = 256
BLOCK_BYTES = 1 << 18
_LONGEST = 60
SCHEMA = "shard int, block int, before bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"


def _reached(steps: np.ndarray) -> np.ndarray:
    """The places that a walk from 0 stops at, where ``steps[i]`` is the step from place i.

    Walks of 2, 4, 8 ... steps from every place; then the places known so far are joined by those a walk of half the length leads to.
    """
    n = len(steps)
    if not n:
        return np.zeros(0, "i8")
    jumps = [np.append(np.minimum(np.arange(n) + steps, n), n)]
    while jumps[-1][0] < n:
        jumps.append(jumps[-1][jumps[-1]])
    places = np.zeros(1, "i8")
    for jump in reversed(jumps):
        places = np.concatenate([places, jump[places]])
        places = places[places < n]
    return np.sort(places)


def pack(ids: np.ndarray) -> bytes:
    """Code unsigned ids; each word takes the layout that holds the most of the next ids."""
    n = len(ids)
    padded = np.zeros(n + _LONGEST, "u8")
    padded[:n] = ids
    if n and int(padded.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    # bits[i]: bits of id i; widest[k][i]: most bits among ids i .. i+k-1
    bits = np.frexp(padded.astype("f8"))[1].astype("u1")
    large = padded >= 1 << 52
    bits[large] = 60
    widest, have = {1: bits}, [1]
    selector = np.zeros(n, "u1")
    for s in range(len(LAYOUTS) - 1, 0, -1):
        count, width = LAYOUTS[s]
        half = max(k for k in have if k <= count)
        while half < count:
            base, step = widest[half], min(half, count - half)
            joined = base.copy()
            joined[: len(base) - step] = np.maximum(base[: len(base) - step], base[step:])
            half += step
            widest[half] = joined
            have.append(half)
        selector[widest[count][:n] <= width] = s
    firsts = _reached(np.array([count for count, _ in LAYOUTS])[selector])
    chosen = selector[firsts] if n else np.zeros(0, "u1")
    words = chosen.astype("u8") << np.uint64(60)
    for s in np.unique(chosen):
        count, width = LAYOUTS[s]
        rows = chosen == s
        held = padded[firsts[rows, None] + np.arange(count)]
        words[rows] |= np.bitwise_or.reduce(held << (np.arange(count, dtype="u8") * np.uint64(width)), axis=1)
    head = np.array([n, len(words)], "<u4").tobytes()
    return head + firsts[::STRIDE].astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``stop``; only the stretches of words that hold them are decoded."""
    n, n_words = np.frombuffer(payload, "<u4", 2).tolist()
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "u8")
    n_offsets = -(-n_words // STRIDE)
    offsets = np.frombuffer(payload, "<u4", n_offsets, 8).astype("i8")
    first = int(np.searchsorted(offsets, start, "right")) - 1
    last = int(np.searchsorted(offsets, stop, "left"))
    words = np.frombuffer(payload, "<u8", n_words, 8 + 4 * n_offsets)[first * STRIDE : last * STRIDE]
    selector = (words >> np.uint64(60)).astype("i8")
    counts = np.array([count for count, _ in LAYOUTS])[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), "u8")
    for s in np.unique(selector):
        count, width = LAYOUTS[s]
        rows = selector == s
        shifts = np.arange(count, dtype="u8") * np.uint64(width)
        mask = np.uint64((1 << width) - 1)
        out[(ends - counts)[rows, None] + np.arange(count)] = (words[rows, None] >> shifts) & mask
    return out[start - offsets[first] : stop - offsets[first]]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, append ``end_id`` and write the ids to ``path`` in ascending ``doc_id``.

    A null text is an empty one, and a document of it holds the end id alone. Rows
    with the same id follow each other in the order of their text; a null id comes
    first. Other columns are not written. The text is range-partitioned once; it is
    encoded after that shuffle, a bounded run of documents at a time, and a document
    is never split over blocks.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder, block, shard, before = encoder(tokenizer), 0, None, 0
        for batch in batches:
            for part in pieces(batch, "text", 8 << 20):
                shard = part.column("shard")[0].as_py() if shard is None else shard
                ids, counts = coder.encode(part.column("text"))
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), end_id, "u8")
                body = np.ones(len(whole), bool)
                body[ends - 1] = False
                whole[body] = ids
                doc_ids = part.column("doc_id").to_pylist()
                rows, starts, first = [], [], 0
                while first < len(doc_ids):
                    done = int(ends[first - 1]) if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_BYTES // 4, "right")))
                    starts.append(before + done)
                    rows.append((doc_ids[first:last], (counts[first:last] + 1).tolist(), pack(whole[done : ends[last - 1]])))
                    first = last
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(rows), pa.int32()),
                        pa.array(range(block, block + len(rows)), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["shard", "block", "before", "doc_ids", "counts", "payload"],
                )
                block += len(rows)
                before += len(whole)

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )
    map_batches(ordered, encode, SCHEMA, encodes=True).write.parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` is binary: unsigned 32-bit little-endian numbers. A block holds its start in its shard; only
    one number for each shard (a task of the writer) is summed up in the driver and sent to the readers, and no block moves.
    """
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = files.groupBy("shard").agg(F.max(F.col("before") + size).alias("ids")).orderBy("shard").collect()
    starts, reached = [], 0
    for row in totals:
        starts.append((row.shard, reached))
        reached += row.ids
    shards = files.sparkSession.createDataFrame(starts, "shard int, before_shard long")
    placed = files.join(F.broadcast(shards), "shard").withColumn("before", F.col("before") + F.col("before_shard"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4").tobytes()
                counts = np.array(row["counts"], "i8")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["before"] + ends - counts),
                        pa.array(counts),
                        pa.array([ids[4 * (b - c) : 4 * b] for b, c in zip(ends.tolist(), counts.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return map_batches(placed.select("doc_ids", "counts", "payload", "before"), decode, "doc_id long, start long, n_tokens long, ids binary")
