import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from rewardmill.llm import mixing, mixing_queries


def brute_rake(tokens, shares, keep, sweeps):
    """tokens: {(a, b): n}; shares: one dict per place."""
    kept = {c: n * keep for c, n in tokens.items()}
    budget = keep * sum(tokens.values())
    for _ in range(sweeps):
        for place, share in enumerate(shares):
            present = {c[place] for c in tokens}
            total = sum(s for v, s in share.items() if v in present and s > 0) or 1
            sums = {}
            for c, k in kept.items():
                sums[c[place]] = sums.get(c[place], 0) + k
            for c in kept:
                want = budget * max(share.get(c[place], 0), 0) / total
                kept[c] = min(kept[c] * want / sums[c[place]] if sums[c[place]] else 0, tokens[c])
    return {c: kept[c] / tokens[c] for c in tokens}


def test_rake_equals_brute_force(spark):
    r = np.random.default_rng(0)
    tokens = {(f"={a}", f"={b}"): int(r.integers(1, 1000)) for a in "xyzw" for b in "mno" if r.random() < 0.8}
    shares = [{"=x": 0.5, "=y": 0.2, "=z": 0.3, "=gone": 0.9}, {"=m": 1.0, "=n": 2.0, "=o": 0.0}]
    cells = spark.createDataFrame([(*c, n) for c, n in tokens.items()], "a string, b string, tokens long")
    targets = {n: spark.createDataFrame(list(s.items()), "value string, share double") for n, s in zip("ab", shares)}
    got = {(r.a, r.b): r.probability for r in mixing.rake(cells, targets, 0.4, 6).collect()}
    want = brute_rake(tokens, shares, 0.4, 6)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_marginals_are_met(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.1')}/documents.parquet")
    rows = mixing.mix(docs, 0.5).cache()
    total = rows.agg(F.sum("tokens")).head()[0]
    for d in ("source", "lang"):
        sums = rows.groupBy(d).agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("probability")).alias("k"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("s")).collect()
        whole = sum(r.n**0.7 for r in sums)
        for r in sums:
            assert r.k / (0.5 * total) == pytest.approx(r.n**0.7 / whole, rel=0.08)  # small topics cannot reach their share
            assert r.s == pytest.approx(r.k, rel=0.25)


def test_given_targets_are_met(spark):
    """Sources at 3 : 1 whatever their sizes, the null source by name, one source without a share gone; ties and null shares."""
    rows = [(i, "w " * 10, s, "en") for i, s in enumerate(["a"] * 600 + ["b"] * 300 + [None] * 300 + ["c"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    target = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.0), (None, 1.0), ("c", None), ("gone", 5.0)], "value string, share double")
    got = mixing.mix(docs, 0.25, targets={"source": target})
    sums = {r.source: r.k for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("k")).collect()}
    budget = 0.25 * 13000
    assert {s: k / budget for s, k in sums.items()} == pytest.approx({"a": 0.2, "b": 0.6, None: 0.2, "c": 0.0})
    assert got.filter("source = 'c' AND kept").count() == 0
    assert got.filter("kept").count() == pytest.approx(325, rel=0.2)
    assert mixing.mix(docs, 0.25, targets={"source": target.filter("false")}).filter("kept").count() == 0
    assert mixing.mix(docs.filter("false"), 0.25, targets={"source": target}).count() == 0
    with pytest.raises(ValueError, match="licence"):
        mixing.mix(docs, 0.25, targets={"licence": target})


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, None, "s", None), (None, "x | y", None, "en"), (3, "", "only empty", "xx"), (4, "w " * 20000, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"kept": F.lit("x"), "tokens": F.lit(-1), "cell_lang": F.lit(1)}).drop("cell_lang")
    got = mixing.mix(df, 1.0, exponent=1.0).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.topic == ("table" if r.doc_id is None else "prose")
        assert r.kept == (r.probability > 0) and (r.probability == pytest.approx(1.0) or r.source == "only empty" or r.doc_id == 2)
    assert mixing.mix(df.filter("false"), 0.5).count() == 0


def test_query_equals_oracle(spark, small):
    name = "op7_raked_mixture"
    for sf in (small, small.replace("0.001", "0.01")):
        assert compare(spark, connect(sf), sf, name, mixing_queries.QUERIES[name], mixing_queries.ORACLES[name]) is None
