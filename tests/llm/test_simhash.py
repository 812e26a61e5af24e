import re

import numpy as np
import pytest
import xxhash

from rewardmill.llm import dedup_queries, simhash
from rewardmill.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_hashes(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return []
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    return [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]


def brute_print(text, size=3):
    h = brute_hashes(text, size)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius):
    """prints: list of (doc_id, number); returns the component id of each row."""
    n = len(prints)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.array([p for _, p in prints], "u8")
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(n)]


TEXTS = ["", None, "  \n", "One", "one two", "A b C d", "a b c D", "É é ß", "x y z w", "w " * 3000, "a b c d e f g h"]


def test_fingerprints_of_odd_texts(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    got = {r.doc_id: r.fp[0] % 2**64 for r in simhash.fingerprints(df, 3).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(TEXTS)}
    wide = {r.doc_id: r.fp for r in simhash.fingerprints(df, 3, lanes=4).collect()}
    assert all(len(v) == 4 and v[0] % 2**64 == got[d] for d, v in wide.items())


def near_rows(seed, n=400):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 40, dtype="u8")
    out = []
    for i in range(n):
        v = int(base[r.integers(0, 40)])
        for b in r.integers(0, 64, r.integers(0, 5)):
            v ^= 1 << int(b)
        out.append((int(i * 37 % n), v))
    return out + [(None, out[0][1]), (None, 1), (5, out[9][1]), out[3]]


@pytest.mark.parametrize("radius,fields,width,tile", [(2, 2, 1, 50), (2, 4, 1, 1 << 17), (3, 1, 2, 100), (0, 2, 1, 64)])
def test_components_equal_brute_force(spark, monkeypatch, radius, fields, width, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = near_rows(radius)
    df = spark.createDataFrame([(d, [v - 2**64 if v >= 2**63 else v]) for d, v in rows], "doc_id long, fp array<bigint>")
    got = simhash.near_duplicate_groups(df, radius, fields, width).collect()
    want = brute_components(rows, radius)
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2] is None, t[2] or 0)
    assert sorted(((r.doc_id, r.fp[0] % 2**64, r.component_id) for r in got), key=key) == sorted(
        ((d, v, c) for (d, v), c in zip(rows, want)), key=key
    )


def test_wide_fingerprints(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, (30, 4), dtype="i8")
    near = base.copy()
    near[:, 1] ^= (1 << 20) - 1
    near[:, 3] ^= (1 << 31) - 1
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, v.tolist()) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, fp array<bigint>")
    for radius, joined in ((51, True), (50, False)):
        got = {x.doc_id: x.component_id for x in simhash.near_duplicate_groups(df, radius, 1, 16).collect()}
        assert all(got[100 + i] == (i if joined else 100 + i) for i in range(30))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_groups(simhash.fingerprints(df, 3), 2).count() == 0


def test_long_paths_and_cycles(spark):
    links = [(i, i + 1) for i in range(300)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500, 502: 500}


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    want = {(d, f"{v:016x}", c) for (d, v), c in zip(prints, brute_components(prints, 2))}
    assert {tuple(r) for r in dedup_queries.op6_simhash_components(spark, small).collect()} == want


@pytest.mark.parametrize("radius,lanes", [(2, 1), (40, 4)])
def test_tiles_along_classes_lose_no_link(spark, radius, lanes):
    """Many small tiles, a large class cut by hash: the same components as all pairs."""
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, (60, lanes), dtype="u8")
    prints = []
    for b in base:
        for _ in range(5):
            flips = np.zeros(lanes * 64, bool)
            flips[r.choice(lanes * 64, radius // 2 if r.random() < 0.8 else radius * 2, replace=False)] = True
            prints.append((b ^ np.packbits(flips).view(">u8").astype("u8")).view("i8").tolist())
    rows = [(i, p, bin(int(np.array(p[:1], "i8").view("u8")[0])).count("1")) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>, class int")
    links = simhash.near_links(nodes, radius, lambda a, b: abs(a - b) <= radius, fields=2, width=1, tile=11)
    roots = {x.node: x.root for x in connected_components(links).collect()}
    fps = np.array(prints, "i8").view("u8").reshape(-1, lanes)
    want = {i: i for i in range(len(fps))}
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]).sum(axis=1) <= radius):
                low = min(want[i], want[int(j)])
                changed |= want[i] != low or want[int(j)] != low
                want[i] = want[int(j)] = low
    assert {i: roots.get(i, i) for i in want} == want
