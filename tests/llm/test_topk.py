import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from rewardmill.llm import search_queries, topk

NAN, INF = float("nan"), float("inf")


def brute(rows, is_query, k):
    fit = {}
    cands = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        cands.append((vec_id, w))
        if is_query(vec_id):
            fit[vec_id] = min(fit.get(vec_id, w), w)
    out = []
    for q, w in fit.items():
        scored = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in cands if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("weights"))
    return sorted(map(tuple, topk.exact_top_k(v.filter(F.col("vec_id") % every == 0), v, k).collect()))


@pytest.mark.parametrize("size", [(7, 3), (4096, 512)])
def test_random_vectors_with_ties_and_holes(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", size[0])
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", size[1])
    r = np.random.default_rng(3)
    rows = [(i, (r.integers(-2, 3, 6) / 256).tolist()) for i in range(150)]
    rows += [(i, rows[10][1]) for i in range(200, 230)]
    rows += [(None, [1.0] * 6), (300, None), (310, [None] + [1.0] * 5), (320, [NAN] * 6), (330, [INF] * 6), (340, []), (350, [0.5])]
    rows += [(20, rows[20][1]), (20, [0.1] * 6)]
    assert run(spark, rows, 5, 10) == brute(rows, lambda i: i % 10 == 0, 5)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, -0.5]), (1, [0.001, 0.2])]
    assert run(spark, rows, 5, 1) == brute(rows, lambda i: True, 5)
    assert run(spark, [], 5, 1) == []
    assert run(spark, [(0, [1.0])], 5, 1) == []


def test_query_equals_oracle(spark, small):
    name = "op5_exact_top_k"
    assert compare(spark, connect(small), small, name, search_queries.QUERIES[name], search_queries.ORACLES[name]) is None


def block_pair(asked, known):
    """Two lists of (id, {term: weight}) as a pair of blocks."""
    pair = {}
    for side, rows in (("q", asked), ("c", known)):
        held = sorted((term, n, w) for n, (_, row) in enumerate(rows) for term, w in row.items() if w)
        terms, counts = np.unique([t for t, _, _ in held], return_counts=True)
        cells = [[i for i, _ in rows], terms, counts, [n for _, n, _ in held], [w for _, _, w in held]]
        pair |= {f"{side}_{name}": topk._cell(np.array(c, "i8"))[0].as_py() for name, c in zip(topk._NAMES, cells)}
        pair[f"{side}_size"] = len(rows)
    return pair


@pytest.mark.parametrize("scale", [1, 10**4, 2**27, 2**40])
def test_scores_of_common_and_rare_terms(monkeypatch, scale):
    """Products and posting lists together, exact in each kind of number; sums beyond 64 bits wrap around."""
    monkeypatch.setattr(topk, "TERMS_AT_ONCE", 3)
    r = np.random.default_rng(5)
    def rows(n):
        made = [{t: int(w) * scale for t, w in enumerate(r.integers(-9, 10, 8))} for _ in range(n)]
        for row in made[:: n // 2]:
            row |= {1000 + int(t): scale for t in r.integers(0, 4, 2)}
        return list(enumerate(made))

    asked, known = rows(40), rows(300)
    want = [[sum(w * c.get(t, 0) for t, w in q.items()) for _, c in known] for _, q in asked]
    wrapped = [[(x + 2**63) % 2**64 - 2**63 for x in row] for row in want]
    assert topk.accumulate(block_pair(asked, known)).astype("i8").tolist() == wrapped


@pytest.mark.parametrize("kind", ["f4", "f8", "i8"])
def test_selection_by_groups(kind):
    """Ties, repeated ids, own rows among the best, and the least integer, against a full sort."""
    r = np.random.default_rng(7)
    scores = r.integers(-40, 40, (30, 2500)).astype(kind)
    ids = r.integers(0, 2000, 2500)
    asked = np.arange(30) * 50
    if kind == "i8":
        scores[3] = np.iinfo("i8").min
    scores[np.isin(ids, asked)[None, :].repeat(30, 0)] = 100
    whole = scores.copy()
    rows, places = topk.select(scores, asked, ids, 5)
    for q, own in enumerate(asked):
        want = sorted((-int(whole[q, p]), int(ids[p])) for p in range(2500) if ids[p] != own)[:5]
        assert [(-int(whole[q, p]), int(ids[p])) for p in places[rows == q]] == want


def test_block_pairs_are_scored_by_products(monkeypatch):
    """A pair of full blocks takes few steps: one product for all terms, none for each query and term."""
    pair = block_pair(*[[(n, {t: 1 + (n + t) % 5 for t in range(64)}) for n in range(size)] for size in (50, 200)])
    steps = []
    of = topk._Postings.of
    monkeypatch.setattr(topk._Postings, "of", lambda self, place: steps.append(place) or of(self, place))
    topk.accumulate(pair)
    assert not steps
