import numpy as np
import pytest

from rewardmill.llm import simhash
from test_simhash import brute_hashes


def sharing(words, first, last, other):
    """``words`` with its part from ``first`` to ``last`` replaced."""
    return words[:first] + [f"{other}{n}" for n in range(last - first)] + words[last:]


def jaccard(a, b):
    x, y = set(brute_hashes(a, 5)), set(brute_hashes(b, 5))
    return len(x & y) / len(x | y)


def planted(n_words, share, seed):
    """A text and one that shares a Jaccard similarity of at most ``share`` with it (at least, for 0.8 and more)."""
    words = [f"w{seed}x{n}" for n in range(n_words)]
    shingles = n_words - 4
    cut = 2 * share / (1 + share) * shingles
    kept = int(np.ceil(cut)) if share >= 0.8 else int(cut)
    return " ".join(words), " ".join(words[: kept + 4] + [f"o{seed}x{n}" for n in range(shingles - kept)])


def brute(rows, radius=51):
    """Ids that stay: checked pairs within the radius are joined."""
    hashes = [np.array(brute_hashes(t, 5), "u8") for _, t in rows]
    fps = np.array([[simhash.bits_of(simhash._mixed(h, lane)) for lane in range(4)] for h in hashes], "u8")
    sets = [set(h.tolist()) for h in hashes]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] == sets[j] or np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if alike:
                a, b = sorted((find(i), find(j)), key=lambda n: rows[n][0])
                group[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def stay(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in simhash.one_of_each_group(df, **options).collect()}


def test_pairs_below_the_similarity_stay(spark):
    """Of 10 or 160 shingles, with similarities from 0.6 to 0.75: all stay. At 0.9 one of each pair goes."""
    rows, low = [], set()
    for seed in range(60):
        for n, share in ((14, 0.67), (164, 0.6), (164, 0.7), (164, 0.75), (164, 0.9)):
            a, b = planted(n, share, f"{seed}s{n}s{int(share * 100)}")
            assert (jaccard(a, b) >= 0.8) == (share >= 0.8)
            at = len(rows)
            rows += [(at, a), (at + 1, b)]
            low |= {at, at + 1} if share < 0.8 else set()
    got = stay(spark, rows)
    assert low <= got
    assert len(got - low) == 60


@pytest.mark.parametrize("block", [600, simhash.BLOCK])
def test_equals_brute_force_with_families_and_chains(spark, block):
    r = np.random.default_rng(3)
    rows = []
    for family in range(6):
        words = [f"f{family}w{n}" for n in range(120)]
        for _ in range(25):
            at = int(r.integers(0, 100))
            rows.append((len(rows) * 7 % 1009, " ".join(sharing(words, at, at + int(r.integers(1, 20)), f"o{len(rows)}"))))
    rows += [(2000, "a b"), (2001, "A  b"), (2002, ""), (2003, None), (2004, "x y z"), (2005, "p q r s t " * 30), (2006, "p q r s t " * 60)]
    want = brute(rows)
    assert 7 < len(want) < len(rows)
    assert stay(spark, rows, block=block) == want


@pytest.mark.parametrize("shingles", [5, 10, 20, 60, 200, 1000])
@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_candidates_hold_planted_pairs(shingles, similarity):
    """At least 0.95 of the pairs at each similarity are within the radius."""
    r = np.random.default_rng(shingles)
    shared = int(np.ceil(2 * similarity / (1 + similarity) * shingles))
    found = 0
    for _ in range(120):
        hashes = r.integers(0, 2**64, 2 * shingles - shared, dtype="u8")
        sides = hashes[:shingles], np.concatenate([hashes[:shared], hashes[shingles:]])
        a, b = (np.array([simhash.bits_of(simhash._mixed(h, lane)) for lane in range(4)], "u8") for h in sides)
        found += int(np.bitwise_count(a ^ b).sum()) <= 51
    assert found >= 0.95 * 120


def test_membership_map_keeps_all_members(spark):
    from pyspark.sql import functions as F

    from rewardmill.llm.common import map_of, maybe_in

    rows = spark.range(-500, 500).select("id", F.xxhash64("id").alias("key"), F.lit(1).alias("bits"))
    members = rows.filter("id % 7 = 0")
    possible, apart = maybe_in(rows, F.col("key"), map_of(members, "key"))
    assert {r.id for r in possible.collect()} >= {i for i in range(-500, 500) if i % 7 == 0}
    assert possible.count() + apart.count() == 1000 and apart.count() > 800 and possible.columns == rows.columns
