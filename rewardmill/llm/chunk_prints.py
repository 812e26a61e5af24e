"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes of a text; where its upper bits are zero a chunk
may end. Chunking is normalised: between the least and the normal length a cut
needs more zero bits, beyond it fewer, and at the greatest length the chunk is
cut. Boundaries depend only on the bytes near them, so they shift with the text
when something before them is edited. The fingerprint is the set of the chunks'
digests, each with its chunk's length; the likeness of one to another is the
share of its length that the other contains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import map_batches, pieces


@dataclass(frozen=True)
class Chunking:
    """Lengths in bytes; ``strict`` and ``loose`` are the zero bits that a cut needs before and after ``normal``."""

    least: int = 16
    normal: int = 32
    greatest: int = 128
    strict: int = 6
    loose: int = 3


#: Bytes that the gear hash sees: one bit of it is shifted out for each byte.
WINDOW = 16
# One random 32-bit number for each byte, by rule.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 0) for b in range(256)], "u4")


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: sum of gear[b] << age over the last ``WINDOW`` bytes, by doubling."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def cuts(data: np.ndarray, bounds: np.ndarray, rule: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk of all texts, and the text it belongs to; ``bounds`` are the texts' places in ``data``.

    All texts advance together, one chunk in each step. No cut lies within ``least`` bytes of a
    text's start, so with ``least`` no shorter than the window a text's cuts do not depend on what lies before it.
    """
    if rule.least < WINDOW:
        raise ValueError("least must be no shorter than the hash's window")
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - rule.loose) == 0) + 1
    strict = loose[h[loose - 1] >> np.uint32(32 - rule.strict) == 0]
    end_mark = np.array([len(data) + rule.greatest + 1])
    loose, strict = np.concatenate([loose, end_mark]), np.concatenate([strict, end_mark])
    text = np.flatnonzero(np.diff(bounds) > 0)
    at, end = bounds[:-1][text], bounds[1:][text]
    starts, texts = [at[:0]], [text[:0]]
    while len(at):
        starts.append(at)
        texts.append(text)
        early = strict[np.searchsorted(strict, at + rule.least)]
        late = loose[np.searchsorted(loose, at + rule.normal)]
        cut = np.where(early < at + rule.normal, early, np.minimum(late, at + rule.greatest))
        going = cut < end
        at, end, text = cut[going], end[going], text[going]
    starts, texts = np.concatenate(starts), np.concatenate(texts)
    order = np.argsort(starts, kind="stable")
    return starts[order], texts[order]


def prints(data: np.ndarray, bounds: np.ndarray, rule: Chunking) -> list[np.ndarray]:
    """Fingerprint of every text: ascending distinct entries, 48 bits of digest above 16 bits of length."""
    starts, texts = cuts(data, bounds, rule)
    ends = np.append(starts[1:], len(data))
    last = np.append(texts[1:] != texts[:-1], True) if len(texts) else np.zeros(0, bool)
    ends[last] = bounds[1:][texts[last]]
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], "u8")
    entries = (hashes >> np.uint64(16) << np.uint64(16)) | (ends - starts).astype("u8")
    per_text = np.searchsorted(texts, np.arange(len(bounds)))
    return [np.unique(entries[a:b]) for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist())]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the length of fingerprint ``a`` that ``b`` contains; 1 for two empty ones, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    lengths = a & np.uint64(0xFFFF)
    held = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
    return float(lengths[held].sum() / lengths.sum())


def shown(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u8").tobytes().hex()


def with_successor_starts(docs: DataFrame, partitions: int) -> DataFrame:
    """Documents dealt out by ranges of ``doc_id``, each range followed by the first document of the next.

    Adds ``part`` and ``guard``. The ranges' first ids come from a sort of the ids alone and are
    as many as ``partitions``; the rows that start a range go also to the range before it, and
    the very first to the last. The wide rows are shuffled once.
    """
    least = -(2**63)
    key = F.coalesce(F.col("doc_id"), F.lit(least))
    ranges = docs.select(key.alias("k")).repartitionByRange(partitions, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    firsts = np.array(sorted({r["k"] for r in ranges.collect()}), "i8")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").fill_null(least).to_numpy()
            part = np.maximum(np.searchsorted(firsts, keys, "right") - 1, 0)
            starts = np.flatnonzero(firsts[part] == keys) if len(firsts) else part[:0]
            rows = pa.concat_arrays([pa.array(np.arange(len(keys))), pa.array(starts)])
            parts = np.concatenate([part, (part[starts] - 1) % max(1, len(firsts))])
            guard = np.arange(len(parts)) >= len(keys)
            columns = [c.take(rows) for c in batch.columns] + [pa.array(parts.astype("i4")), pa.array(guard)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "part", "guard"])

    placed = map_batches(docs, place, "doc_id long, text string, part int, guard boolean")
    return placed.repartition("part").sortWithinPartitions("part", "guard", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, rule: Chunking = Chunking(), partitions: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and measure what they contain of each other.

    The edited text has its last floor(n/4) code points replaced by the first as many of the
    next document's text, in ascending order of ``doc_id`` (after the last comes the first;
    a null id comes first, rows with one id follow in the order of their text). Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    chunks. A null text is an empty one, with an empty fingerprint. Other columns are not read.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_successor_starts(texts, partitions)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, chunks long"
    )

    def finished(rows: list[tuple[int | None, str]], last: str | None) -> pa.RecordBatch:
        """``rows`` with their successor's text in ``last``; for all but the last row it is the next row."""
        own = [text for _, text in rows]
        after = [*own[1:], last]
        edited = [(t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode() for t, n in zip(own, after)]
        raw = [t.encode() for t in after[-1:]]
        everything = [*[t.encode() for t in own], *raw, *edited]
        bounds = np.cumsum([0, *map(len, everything)])
        found = prints(np.frombuffer(b"".join(everything), "u1"), bounds, rule)
        n = len(own)
        mine, changed = found[:n], found[n + 1 :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in rows], pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([shown(f) for f in mine], pa.string()),
                pa.array([shown(f) for f in changed], pa.string()),
                pa.array([containment(a, b) for a, b in zip(mine, changed)], pa.float64()),
                pa.array([containment(a, b) for a, b in zip(mine, found[1 : n + 1])], pa.float64()),
                pa.array([len(f) for f in mine], pa.int64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "chunks"],
        )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, waiting, closed = None, None, False
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                ready: list[tuple[int | None, str]] = []
                for doc_id, text, at, guard in zip(*[c.to_pylist() for c in piece.columns]):
                    if at != part:
                        part, waiting, closed = at, None, False
                    if closed:
                        continue  # more rows of the id that starts the next range
                    if waiting is not None:
                        ready.append(waiting)
                        if guard:
                            yield finished(ready, text)
                            ready = []
                    waiting, closed = (None, True) if guard else ((doc_id, text), False)
                if ready:
                    yield finished(ready, waiting[1])

    return map_batches(rows, measure, schema)
