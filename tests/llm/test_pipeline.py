import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_near_dedup import brute
from test_simhash import brute_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_subsets(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "source_mixing", "packing"]
    for before, after in zip(stages, stages[1:5]):
        assert after.columns == before.columns and ids(after) <= ids(before)
        assert after.exceptAll(before).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark, stages):
    kept = ids(stages[1])
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_language_drops_next_to_nothing_clean(stages):
    assert len(ids(stages[2])) >= 0.99 * len(ids(stages[1]))


def test_near_dedup_equals_brute_force(stages):
    """Pairs within the radius whose sets have a Jaccard similarity of 0.8 are joined; the smallest id of a group stays."""
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    assert ids(stages[3]) == brute([(r.doc_id, r.text) for r in rows])


def test_near_dedup_leaves_no_pair_of_alike_texts(stages):
    kept = stages[3].collect()
    where = {}
    sets = [frozenset(brute_hashes(r.text, 5)) for r in kept]
    for i, s in enumerate(sets):
        for h in s:
            where.setdefault(h, []).append(i)
    shared = {}
    for docs in where.values():
        if len(docs) < 50:
            for a in docs:
                for b in docs:
                    if a < b:
                        shared[a, b] = shared.get((a, b), 0) + 1
    alike = [1 for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.85]
    assert not alike


def test_packing_holds_all_tokens(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == ids(stages[4])
    for doc_id in list(ids(stages[4]))[:50]:
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in mine) == mine[0].doc_tokens and zlib.crc32(mine[0].ids) and mine[-1].ids[-4:] == b"\x01\0\0\0"


def test_run_equals_the_stages(spark, stages):
    got = cp.run(spark, SF).select("doc_id", "start", "length", "ids")
    want = stages[5].select("doc_id", "start", "length", "ids")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_stages_take_odd_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "", "xx", "s", 0), (3, "w " * 60000, "en", "s", 1), (3, "w " * 60000, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.filter("false")):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name == "simhash_near_dedup" and docs is df:
                assert n == 3  # null and empty are alike, the repeated row stays once


CLASHES = ["score", "topic", "tokens", "probability", "kept", "rejected", "lang_pred", "Weight", "__weight", "__id", "__text", "id", "node", "row", "hash"]


def test_columns_of_any_name_survive(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.exceptAll(docs).count() == 0 and out.count() > 0, name
