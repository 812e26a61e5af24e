import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardmill.llm import quality_queries
from rewardmill.llm import resampling as rs
from rewardmill.llm.common import utf8

import pyarrow as pa

WORDS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\t-\r ]+")


def brute_grams(text, buckets):
    def word_hash(w):
        h = sum((b + 1) * pow(0x100000001B3, i, 2**64) for i, b in enumerate(w)) % 2**64
        return finish(h)

    def finish(h):
        h = (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2**64
        return h ^ (h >> 29)

    h = [word_hash(w) for w in WORDS.findall((text or "").encode().lower())]
    pairs = [finish((a * 0x100000001B3 + b + 1) % 2**64) for a, b in zip(h, h[1:])]
    return sorted(x % buckets for x in h + pairs)


TEXTS = ["", None, "one", "One two, THREE!! é中 x_1", "a | b |c", " \n\t", "same", "words " * 4000, "\x0b\x1cq"]


def test_ngrams_equal_brute_force():
    grams, owner = rs.ngrams(*utf8(pa.array(TEXTS)), 1 << 14)
    for i, t in enumerate(TEXTS):
        assert sorted(grams[owner == i].tolist()) == brute_grams(t, 1 << 14)


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(0)
    good, bad = [f"g{i}" for i in range(50)], [f"$${i}" for i in range(20)]
    rows = [(i, " ".join(r.choice(bad if i % 5 == 0 else good, r.integers(5, 60))), -1.0) for i in range(300)]
    return spark.createDataFrame([*rows, (None, "g1 g2", 0.0), (901, None, 0.0), (902, "", 0.0), rows[7], rows[7]], "doc_id long, text string, log_weight double")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (2, None, 0), (6, 0, 1), (6, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, good int")


def test_ratio_equals_brute_force(docs, labels):
    sample = rs.labelled(labels)
    learn = {r.doc_id for r in sample.collect() if r.good and r.learn}
    raw, target = np.zeros(512), np.zeros(512)
    for r in docs.collect():
        for g in brute_grams(r.text, 512):
            raw[g] += 1
            target[g] += r.doc_id in learn
    share = (raw + 1 / 512) / (raw.sum() + 1)
    want = np.log((target + 64 * share) / (target.sum() + 64)) - np.log(share)
    assert np.allclose(rs.fit_ratio(docs, sample, 512), want)


def test_selection_parts_good_from_bad(docs, labels):
    _, weights, least = rs.select_quality(docs, labels)
    rows = weights.withColumn("selected", rs.drawn(F.col("log_weight"), F.col("doc_id"), least)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (901, 902):
            assert r.log_weight is None and not r.selected
        elif r.doc_id is not None:
            assert r.selected == (r.doc_id % 5 != 0)


def test_draw_is_gumbel_top_k(spark):
    rows = [(i, float(i % 7) / 3) for i in range(500)] + [(None, 1.0), (800, None), (3, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, log_weight double")

    def key(d, w):
        u = (int(hashlib.md5(f"5:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return math.floor((w - math.log(-math.log(u))) * 1e6 + 0.5)

    keys = sorted((key(d, w) for d, w in rows if w is not None), reverse=True)
    for k in (1, 17, 502):
        assert abs(rs.draw(df, k, 5) - keys[k - 1]) <= 1
    assert rs.draw(df, 9999, 5) == rs.draw(df, 502, 5)
    assert rs.draw(df, 0, 5) is None and rs.draw(df.filter("false"), 5, 5) is None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_inclusion_follows_the_weights(spark, seed):
    # Half of the documents have the weight 1, half 3; a tenth is drawn.
    df = spark.range(20000).selectExpr("id doc_id", "IF(id % 2 = 0, 0.0D, ln(3.0D)) log_weight")
    least = rs.draw(df, 2000, seed)
    got = df.filter(rs.drawn(F.col("log_weight"), F.col("doc_id"), least, seed)).groupBy("log_weight").count().orderBy("log_weight").collect()
    low, high = [r["count"] / 10000 for r in got]
    # A key passes t with probability 1 - exp(-weight * exp(-t)).
    rate = -math.log(1 - low)
    assert high == pytest.approx(1 - math.exp(-3 * rate), rel=0.12) and low + high == pytest.approx(0.2)


def test_noise_decides_between_close_weights_only(spark, docs, labels):
    ratio, weights, least = rs.select_quality(docs, labels, seed=3, k=100)
    rows = [r for r in weights.withColumn("kept", rs.drawn(F.col("log_weight"), F.col("doc_id"), least, 3)).collect() if r.log_weight is not None]
    best = sorted(rows, key=lambda r: -r.log_weight)
    assert 100 <= sum(r.kept for r in rows) <= 102
    assert {r.doc_id for r in best[:100]} != {r.doc_id for r in rows if r.kept}
    assert not any(r.kept for r in rows if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0)


def test_kth_largest_exact(spark):
    values = np.random.default_rng(2).integers(-(10**12), 10**12, 3000).tolist() + [5] * 50
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x long")
    for k in (1, 2, 1500, 3050):
        assert rs.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert rs.kth_largest(df, "x", 3051) is None


def test_without_labels_or_documents(docs, labels):
    _, weights, least = rs.select_quality(docs, labels.filter("false"))
    kept = weights.filter(rs.drawn(F.col("log_weight"), F.col("doc_id"), least)).count()
    assert kept == docs.count() - 2
    _, weights, least = rs.select_quality(docs.filter("false"), labels)
    assert weights.count() == 0 and least is None


def test_query_keeps_good_and_drops_bad(spark, small):
    small = small.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality_queries.op9_importance_resampling(spark, small).collect()}
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    good = [rows[r.doc_id].selected for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].selected for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)
