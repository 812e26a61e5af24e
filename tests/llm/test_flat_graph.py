import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardmill.llm import flat_graph, vector_queries


def brute(rows, least=0.9):
    fit = [
        i for i, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {i: set() for i in range(len(rows))}
    for dims in {len(rows[i][1]) for i in fit}:
        here = np.array([i for i in fit if len(rows[i][1]) == dims])
        x = np.array([rows[i][1] for i in here], "f8")
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a != b:
                links[int(here[a])].add(int(here[b]))
    root = {}
    for i in links:
        if i in root:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        for j in seen:
            root[j] = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
    return [(rows[i][0], len(links[i]), root[i]) for i in links]


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).repartition(4)
    got = flat_graph.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return got


def groups(seed, n, dims, planted):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    rows = [x[i] for i in range(n)]
    for size, noise in planted:
        base = r.normal(size=dims)
        rows += [base + noise * r.normal(size=dims) for _ in range(size)]
    order = r.permutation(len(rows))
    return [(int(i), rows[j].tolist()) for i, j in enumerate(order)]


def test_holes_copies_and_lengths(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, i / 10, 0.0]) for i in range(12)]
    rows += [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 0.0]), (24, [inf, 1.0, 0.0]), (25, [nan, 1.0, 0.0])]
    rows += [(30, [1e200, 1e199, 0.0]), (31, [1e-200, 1e-201, 0.0]), (32, [2.0, 0.0]), (33, [4.0, 0.1]), (34, [7.0])]
    rows += [(40, [0.0, 0.0, 5.0]), (40, [0.0, 0.0, 5.0]), (41, [0.0, 0.0, 5.0]), (None, [0.0, 0.0, 5.0]), (None, [0.0, -9.0, 0.0]), (None, None)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in run(spark, rows)]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_empty(spark):
    assert run(spark, []) == []
    assert [tuple(r)[:4] for r in run(spark, [(3, [1.0, 2.0])])] == [(3, 0, 3, True)]


@pytest.mark.parametrize("shard,planted", [(64, [(2, 0.05)] * 60 + [(300, 0.05), (40, 0.2)]), (128, [(900, 0.1)]), (50, [(3, 0.28)] * 100)])
def test_shards_and_dense_groups(spark, monkeypatch, shard, planted):
    """Over many shards nearly all links are found, none that does not hold, and dense groups that no shard can hold stay one component."""
    monkeypatch.setattr(flat_graph, "SHARD", shard)
    rows = groups(shard, 600, 24, planted)
    want = {v: (n, c) for v, n, c in brute(rows)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in run(spark, rows)}
    assert got.keys() == want.keys()
    assert all(got[v][0] <= want[v][0] for v in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[v][1] == want[v][1] for v in want) >= 0.97 * len(want)


def test_pruning_drops_what_a_kept_neighbour_is_nearer_to():
    line = np.array([[1.0, x] for x in (0.0, 0.01, 0.02, 0.03, 0.5)])
    line /= np.sqrt((line * line).sum(axis=1, keepdims=True))
    sources, targets = flat_graph.pruned_graph(line)
    edges = set(zip(sources.tolist(), targets.tolist()))
    assert (0, 1) in edges and (1, 2) in edges and (2, 3) in edges and (3, 4) in edges
    assert (0, 2) not in edges and (0, 3) not in edges
    assert all((b, a) in edges for a, b in edges)


def test_query_on_the_small_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = vector_queries.op11_near_vectors(spark, small).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
