"""Exact top-k search by exhaustive term-at-a-time accumulation.

Both sides are sparse rows of integer weights: positions in the vector are the
terms. Candidates are packed, where they are read, into blocks of posting lists
(for each term the rows that hold it and their weights); queries are packed into
blocks of sparse rows. A pair of blocks is scored by one dense array: terms that
many rows hold are added as a product of matrices, other terms by their weighted
posting lists. Products are taken in floating point where all sums are whole numbers
that it holds exactly, else in integers. The best k of each query stand above the
k-th largest of the maxima of its groups of candidates; the short lists of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rewardmill.llm.common import map_batches

CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 1024
# Queries whose best are looked for at a time, terms of one product of matrices, and groups of candidates whose maxima are compared.
QUERIES_AT_ONCE = 256
TERMS_AT_ONCE = 256
GROUPS = 256
# Whole numbers below these are exact; of these pairs of rows and terms at least one in so many must be held for a product.
_EXACT = {"f4": 2.0**23, "f8": 2.0**52}
_HELD_ONE_IN = 64
_BLOCK = "ids binary, terms binary, counts binary, rows binary, weights binary, size int"
_NAMES = ["ids", "terms", "counts", "rows", "weights", "size"]


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, taken as double; null if any is null or not finite."""
    whole = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    fit = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(fit, whole)


def _cell(values: np.ndarray) -> pa.Array:
    """Integers as one cell: the width in bytes that holds them all, and they in that width."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return pa.array([bytes([width]) + values.astype(f"<i{width}").tobytes()], pa.binary())


def _integers(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, f"<i{cell[0]}", offset=1).astype("i8")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack (id, weights) rows into blocks of posting lists, inside the task that reads them."""

    def packed(ids: list[np.ndarray], vectors: list[pa.Array]) -> pa.RecordBatch:
        lists = pa.concat_arrays(vectors)
        lengths = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(lengths)), lengths)
        term = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        weight = lists.flatten().to_numpy(zero_copy_only=False)
        held = weight != 0
        order = np.argsort(term[held], kind="stable")
        terms, counts = np.unique(term[held], return_counts=True)
        cells = [np.concatenate(ids), terms, counts, row[held][order], weight[held][order]]
        return pa.RecordBatch.from_arrays([*map(_cell, cells), pa.array([len(lengths)], pa.int32())], _NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                ids.append(part.column(0).to_numpy())
                vectors.append(part.column(1))
                held, at = held + part.num_rows, at + part.num_rows
                if held == size:
                    yield packed(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield packed(ids, vectors)

    return map_batches(rows, pack, _BLOCK)


class _Postings:
    """One side of a block pair: terms in order, and for each the rows that hold it with their weights."""

    def __init__(self, pair: dict, side: str):
        self.terms, self.counts, self.rows, self.weights = (_integers(pair[f"{side}_{n}"]) for n in _NAMES[1:5])
        self.ends, self.size = np.cumsum(self.counts), pair[f"{side}_size"]

    def of(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[place] - self.counts[place], self.ends[place])
        return self.rows[at], self.weights[at]

    def matrix(self, places: np.ndarray, kind: str) -> np.ndarray:
        """Rows down and the terms at ``places`` across; zero where a row does not hold a term."""
        counts = self.counts[places]
        column = np.repeat(np.arange(len(places)), counts)
        at = np.arange(len(column)) + np.repeat(self.ends[places] - np.cumsum(counts), counts)
        dense = np.zeros((self.size, len(places)), kind)
        dense[self.rows[at], column] = self.weights[at]
        return dense

    def largest(self) -> float:
        return float(np.abs(self.weights.astype("f8")).max(initial=0.0))

    def largest_sum(self) -> float:
        """No row's absolute weights sum to more."""
        return float(np.bincount(self.rows, np.abs(self.weights.astype("f8")), 1).max())


def accumulate(pair: dict) -> np.ndarray:
    """Scores of one block pair, queries down and candidates across.

    They are floating-point numbers if no sum can leave the whole numbers that these hold exactly, else integers of 64 bits.
    """
    asked, known = _Postings(pair, "q"), _Postings(pair, "c")
    bound = asked.largest_sum() * known.largest()
    kind = next((k for k, limit in _EXACT.items() if bound < limit), "i8")
    scores = np.zeros((asked.size, known.size), kind)
    _, q_places, c_places = np.intersect1d(asked.terms, known.terms, assume_unique=True, return_indices=True)
    # Terms held by many rows of both sides go into products; integers have no fast one.
    held = asked.counts[q_places] * known.counts[c_places] * _HELD_ONE_IN >= asked.size * known.size
    many = held & (kind != "i8")
    for n in range(0, int(many.sum()), TERMS_AT_ONCE):
        at = np.flatnonzero(many)[n : n + TERMS_AT_ONCE]
        scores += asked.matrix(q_places[at], kind) @ known.matrix(c_places[at], kind).T
    for n in np.flatnonzero(~many):
        queries, query_weights = asked.of(q_places[n])
        rows, weights = known.of(c_places[n])
        for q, w in zip(queries, query_weights):
            scores[q, rows] += w * weights
    return scores


def select(scores: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the ``k`` best of every row: high scores first, ties to the smaller id, the row's own id (``asked``) left out."""
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], asked, side) for side in ("left", "right"))
    own = np.repeat(np.arange(len(asked)), last - first)
    own_places = by_id[np.arange(len(own)) + np.repeat(last - np.cumsum(last - first), last - first)]
    whole = scores.dtype.kind == "i"
    scores[own, own_places] = np.iinfo(scores.dtype).min if whole else -np.inf
    groups = max(GROUPS, 4 * k)
    if len(ids) < 2 * groups:
        best = np.ones(scores.shape, bool)
    else:
        # As many groups have a maximum that is no less as rows are wanted.
        wide = len(ids) // groups
        maxima = scores[:, : wide * groups].reshape(len(asked), wide, groups).max(axis=1)
        best = scores >= np.partition(maxima, groups - k, axis=1)[:, groups - k, None]
    best[own, own_places] = False
    rows, places = np.divmod(np.flatnonzero(best), max(len(ids), 1))
    found = scores[rows, places]
    order = np.lexsort((ids[places], ~found if whole else -found, rows))
    rows, places = rows[order], places[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], places[kept]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` candidates with the highest inner product for every query.

    Both tables hold ``vec_id`` and ``weights`` (array of bigint). Returns query_id,
    rank (from 1), vec_id, score. Every query is compared with every candidate, in
    blocks, except with rows of its own id. Rows without id or weights, or with a null
    weight, take no part. Vectors may differ in length: a missing position counts as
    zero. Rows that repeat an id are candidates each; as a query an id is taken once,
    with the least of its vectors. Sums beyond 64 bits wrap around.
    """
    fit = F.col("vec_id").isNotNull() & F.col("weights").isNotNull() & F.forall("weights", lambda x: x.isNotNull())
    vectors = candidates.filter(fit).select(F.col("vec_id").cast("long"), "weights")
    asked = queries.filter(fit).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("weights").alias("weights"))
    right = _blocks(vectors, CANDIDATES_PER_BLOCK)
    left = _blocks(asked, QUERIES_PER_BLOCK)
    # Blocks meet in lanes: a candidate block has one, and the far fewer query blocks are sent to all. Lanes are dealt
    # as they are, not joined to tasks by their bytes: the work is the product of both sides.
    lanes = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    right = right.select(F.pmod(F.xxhash64("ids"), F.lit(lanes)).alias("lane"), *[F.col(n).alias(f"c_{n}") for n in _NAMES])
    left = left.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), *[F.col(n).alias(f"q_{n}") for n in _NAMES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1).to_pylist()[0]
                asked_ids, ids = _integers(pair["q_ids"]), _integers(pair["c_ids"])
                scores = accumulate(pair)
                for start in range(0, len(scores), QUERIES_AT_ONCE):
                    near, part = asked_ids[start : start + QUERIES_AT_ONCE], scores[start : start + QUERIES_AT_ONCE]
                    rows, places = select(part, near, ids, k)
                    cells = [near[rows], ids[places], part[rows, places].astype("i8")]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["query_id", "vec_id", "score"])

    pairs = right.repartition(lanes, "lane").join(left.repartition(lanes, "lane"), "lane").drop("lane")
    short = map_batches(pairs, score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = short.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
