import hashlib

import numpy as np
import pytest

from rewardmill.llm import chunk_prints as cp
from rewardmill.llm import fingerprint_queries

RULE = cp.Chunking()


def brute_chunks(raw, rule=RULE):
    gear = cp._GEAR.tolist()
    out, start = [], 0
    while start < len(raw):
        cut = len(raw)
        for at in range(start + rule.least, min(len(raw), start + rule.greatest + 1)):
            if at == start + rule.greatest:
                cut = at
                break
            h = 0
            for b in raw[max(0, at - cp.WINDOW) : at]:
                h = (h * 2 + gear[b]) % 2**32
            need = rule.strict if at < start + rule.normal else rule.loose
            if h >> (32 - need) == 0:
                cut = at
                break
        out.append(raw[start:cut])
        start = cut
    return out


def brute_print(text):
    return {(cp.xxhash.xxh64_intdigest(c) >> 16, len(c)) for c in brute_chunks(text.encode())}


def brute_share(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return sum(n for x, n in a if (x, n) in b) / sum(n for _, n in a)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(rows)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, e, n = brute_print(t), brute_print(edited), brute_print(after)
        show = lambda s: "".join(sorted(f"{x:012x}{k:04x}" for x, k in s))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), brute_share(a, e), brute_share(a, n)))
    return out


def check(spark, rows, partitions):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, part int, guard string")
    got = [tuple(r)[:7] for r in cp.fingerprint_edits(df, partitions=partitions).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def texts(n, seed):
    r = np.random.default_rng(seed)
    words = ["".join(chr(c) for c in r.choice([97, 101, 115, 116, 233, 0x4E2D, 0x1F600], r.integers(1, 9))) for _ in range(80)]
    return [" ".join(r.choice(words, int(r.integers(0, 120)))) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_equals_brute_force(spark, partitions):
    made = texts(30, 5)
    rows = [(i * 11 % 30, t) for i, t in enumerate(made)]
    rows += [(None, made[3]), (None, None), (7, made[7]), (7, ""), (7, made[7]), (31, "a" * 3000), (32, "ab"), (33, None)]
    check(spark, rows, partitions)


def test_one_row_and_empty(spark):
    check(spark, [(5, "only one text here, its successor is itself")], 4)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert cp.fingerprint_edits(df).count() == 0


def test_boundaries_follow_an_insertion():
    text = " ".join(texts(20, 9)).encode()
    a, b = set(brute_chunks(text)), set(brute_chunks(text[:300] + b"something new" + text[300:]))
    assert sum(map(len, a & b)) > 0.9 * len(text)


def test_short_hash_window_is_refused():
    with pytest.raises(ValueError):
        cp.cuts(np.zeros(4, "u1"), np.array([0, 4]), cp.Chunking(least=8))


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {tuple(r)[:7] for r in fingerprint_queries.op4_chunk_fingerprints(spark, small).collect()}
    assert got == set(brute(docs))
