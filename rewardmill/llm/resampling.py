"""Quality classification by importance resampling of hashed n-grams.

Two generative models give the probability of a document as a bag of hashed
words and word pairs: one of target text (documents labelled good), one of raw
text (all documents). The log ratio of the two is a document's importance
weight, taken per n-gram and for a text of ``STRENGTH`` n-grams, so that a text
is not judged by its length. Adding Gumbel noise to the log weights and taking
the k largest draws k documents without replacement in proportion to their
weights. ``k`` is the caller's, or how many are worth drawing is read off the noisy keys of labelled
documents that the target model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rewardmill.llm.common import map_batches, pieces, stored, utf8

#: Hash buckets of a model; what is gathered and sent to tasks is this many numbers.
BUCKETS = 1 << 14
#: Labelled documents used, at most, chosen by a hash of their id: half for the target model, half for the cut.
LABELLED = 20_000
#: Length in n-grams for which weights are given: the tempering. Documents whose mean log ratio differs by much more
#: than ``1 / STRENGTH`` are told apart, those closer are drawn by chance in proportion to their weights.
STRENGTH = 50
#: Bytes of text whose n-grams are taken at a time; the arrays for it take about 60 times as much of a worker's memory.
PIECE = 512 << 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)
# Byte classes: 0 blank, 1 letter, digit or part of a longer character, 2 other signs.
_CLASS = np.full(256, 2, "u1")
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def ngrams(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair of all texts, and the text it belongs to, in the order of texts.

    A word is a run of letters and digits, or a run of other signs, in lower case for A-Z. A pair
    is two words in a row of one text. A word's hash is a polynomial of its bytes, taken for
    all words at once from running sums.
    """
    if not len(data):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[bounds[:-1][bounds[:-1] < len(data)]] = True
    edges = np.flatnonzero(new)
    starts = edges[kind[edges] > 0]
    ends = np.append(edges[1:], len(data))[kind[edges] > 0]
    power = np.full(len(data) + 1, _PRIME, "u8")
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
    back = np.full(len(data) + 1, inverse, "u8")
    back[0] = 1
    back = np.cumprod(back)
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum((_LOWER[data].astype("u8") + np.uint64(1)) * power[:-1], out=sums[1:])
    word = _finished((sums[ends] - sums[starts]) * back[starts])
    text = np.searchsorted(bounds, starts, "right") - 1
    pair = _finished(word[:-1] * _PRIME + word[1:] + np.uint64(1))
    same = text[:-1] == text[1:]
    hashes = np.concatenate([word, pair[same]])
    owner = np.concatenate([text, text[:-1][same]])
    order = np.argsort(owner, kind="stable")
    return (hashes[order] % np.uint64(buckets)).astype("i8"), owner[order]


def grams_of(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in pieces of whole texts, each with its ``ngrams``."""
    for part in pieces(batch, "text", PIECE):
        yield part, *ngrams(*utf8(part.column("text")), buckets)


def labelled(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, good and learn of at most ``limit`` labelled documents, the least by a hash of the id.

    A document is good if all its labels have quality 1; labels without id or quality say nothing.
    Those with ``learn`` make the target model, the others the cut.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    order = F.xxhash64("doc_id")
    return each.withColumn("learn", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).orderBy(order, "doc_id").limit(limit)


def fit_ratio(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability for every bucket, from one pass over all documents.

    The raw counts cover every document of ``docs``; the target counts the good ones of the
    learning half of ``sample`` (see ``labelled``), whose ids are broadcast. Each task
    sends one count per bucket, and ``buckets`` sums come to the driver. Both
    counts are smoothed: the raw share of a bucket is added to its target count ``buckets`` / 8 times over.
    Without labels or documents the ratio is zero everywhere.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        raw, target = np.zeros(buckets, "i8"), np.zeros(buckets, "i8")
        for batch in batches:
            for part, grams, owner in grams_of(batch, buckets):
                good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[good[owner]], minlength=buckets)
        held = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held, raw[held], target[held])], ["bucket", "raw", "target"])

    good = F.broadcast(sample.filter("good AND learn").select("doc_id", "good"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = map_batches(texts, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in sums.collect():
        raw[bucket], target[bucket] = r, t
    if not raw.sum() or not target.sum():
        return np.zeros(buckets)
    share = (raw + 1 / buckets) / (raw.sum() + 1)
    smooth = buckets / 8
    return np.log((target + smooth * share) / (target.sum() + smooth)) - np.log(share)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id: the same on every run; repeated ids draw alike."""
    whole = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return -F.log(-F.log((whole.cast("double") + 0.5) / F.lit(float(16**13))))


def with_log_weight(docs: DataFrame, ratio: np.ndarray, output: str = "log_weight") -> DataFrame:
    """All columns and rows of ``docs`` with the log importance weight of ``text``; null where it has no word."""
    rest = docs.drop(output)
    schema = StructType([*rest.schema.fields, StructField(output, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for part, grams, owner in grams_of(batch, len(ratio)):
                held = np.bincount(owner, minlength=part.num_rows)
                total = np.bincount(owner, ratio[grams], minlength=part.num_rows)
                weight = STRENGTH * total / np.maximum(held, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight, mask=held == 0)], [*part.schema.names, output])

    return map_batches(rest, score, schema)


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The exact k-th largest of a bigint column (nulls left out), or None if there are fewer than k.

    Each pass counts the values of the remaining range in at most 4,096 bins and goes on in the bin
    of the k-th, until a bin is one number. Only these counts come to the driver. Store ``values`` first.
    """
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).head()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) // 4096 + 1
        inside = values.filter(F.col(column).between(low, high))
        bins = inside.groupBy(F.expr(f"({column} - {low}L) div {width}L").alias("bin")).count().collect()
        for number, held in sorted(map(tuple, bins), reverse=True):
            if held >= k:
                low, high = low + number * width, min(high, low + (number + 1) * width - 1)
                break
            k -= held
    return low


def sampling_key(log_weight: Column, doc_id: Column, seed: int) -> Column:
    """Log weight plus Gumbel noise, in millionths; null where the weight is null."""
    return F.round((log_weight + gumbel(doc_id, seed)) * 1_000_000).cast("long")


def draw(weights: DataFrame, k: int, seed: int) -> int | None:
    """The least sampling key among the ``k`` largest; all rows with at least this key are drawn.

    Rows with one key are drawn together, so ties at the end may give a few rows more than
    ``k``. With fewer than ``k`` weighted rows all of them are drawn (the key is then the least there is).
    ``weights`` has doc_id and log_weight; store it first. None if no row has a weight or ``k`` is 0.
    """
    keys = weights.select(sampling_key(F.col("log_weight"), F.col("doc_id"), seed).alias("key"))
    n = keys.agg(F.count("key")).head()[0]
    return kth_largest(keys, "key", min(k, n)) if k > 0 and n else None


def cut_key(weights: DataFrame, sample: DataFrame, seed: int) -> int | None:
    """The sampling key that best parts good from bad among the labelled documents kept for it.

    Of all cuts the one with the largest sum of the shares of good documents at or above it and of bad
    ones below it; of equal ones the lowest. At most as many keys as ``sample`` has rows come to the
    driver. Without documents of both kinds, or of any use, nothing is cut off: None.
    """
    kept = F.broadcast(sample.filter(~F.col("learn")))
    key = sampling_key(F.col("log_weight"), F.col("doc_id"), seed)
    rows = weights.join(kept, "doc_id").filter(F.col("log_weight").isNotNull()).withColumn("key", key)
    rows = rows.groupBy("doc_id").agg(F.min("key").alias("key"), F.min("good").alias("good")).select("key", "good").toPandas()
    good, bad = np.sort(rows["key"][rows["good"]].to_numpy()), np.sort(rows["key"][~rows["good"]].to_numpy())
    if not len(good) or not len(bad):
        return None
    cuts = np.append(good, bad[-1] + 1)
    gain = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = int(np.argmax(gain))
    below = bad[bad < cuts[best]]
    return int((cuts[best] + below[-1] + 1) // 2) if len(below) else None


def select_quality(docs: DataFrame, labels: DataFrame, seed: int = 0, k: int | None = None) -> tuple[np.ndarray, DataFrame, int | None]:
    """Fit on ``docs`` and ``labels``, weigh all documents, draw: the ratio, (doc_id, log_weight), the least key drawn.

    Without a ``k`` as many documents are drawn as have a key at or above ``cut_key``. The weights are written once
    to the shared folder; texts are read twice and never shuffled.
    """
    sample = stored(labelled(labels), "labelled")
    ratio = fit_ratio(docs, sample)
    scored = with_log_weight(docs.select(F.col("doc_id").cast("long"), "text"), ratio).select("doc_id", "log_weight")
    weights = stored(scored, "log-weights")
    if k is None:
        cut = cut_key(weights, sample, seed)
        worth = weights.filter(F.col("log_weight").isNotNull())
        if cut is not None:
            worth = worth.filter(sampling_key(F.col("log_weight"), F.col("doc_id"), seed) >= cut)
        k = worth.count()
    return ratio, weights, draw(weights, k, seed)


def drawn(log_weight: Column, doc_id: Column, least: int | None, seed: int = 0) -> Column:
    """Whether a row is among the drawn; a row without weight never is."""
    return F.coalesce(sampling_key(log_weight, doc_id, seed) >= F.lit(least), F.lit(False))
