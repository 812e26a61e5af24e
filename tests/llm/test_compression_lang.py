import zlib

import numpy as np
import pytest

from rewardmill.llm import compression_lang as cl
from rewardmill.llm import language_queries

WORDS = {"aa": "salo mira tevo luna".split(), "bb": "krag dron vulk hash".split(), "cc": "éué ôle çai ùor".split()}


def text(lang, n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang, 40 + i, i), lang) for i, lang in enumerate(list(WORDS) * 40)]
    rows += [(500, "x " * 300_000, "aa"), (501, None, "aa"), (502, "no language", None), (None, text("aa", 9, 1), "aa"), rows[0], (503, "", "dd")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_model_is_bounded_and_knows_only_languages_with_text(docs):
    model = cl.fit_languages(docs, sampled=20, dictionary_bytes=2048)
    assert model.names() == ["aa", "bb", "cc"]
    assert all(0 < len(d) <= 2048 for d in model.dictionaries.values())


def test_predictions(spark, docs):
    model = cl.fit_languages(docs, sampled=20, dictionary_bytes=8192)
    rows = [(1, text("aa", 30, 7), "aa"), (2, text("bb", 9000, 8), "bb"), (3, text("cc", 5, 9), "cc"), (4, None, "und"), (5, "", "und"),
            (6, "123 !! 45", "und"), (None, text("bb", 20, 4), "bb"), (1, text("aa", 30, 7), "aa")]
    df = spark.createDataFrame([(d, t, w, 9.9, "clash") for d, t, w in rows], "doc_id long, text string, want string, score double, lang_pred string")
    got = cl.identify_languages(df, model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.want for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.rejected == (r.want == "und") for r in got)


def test_whole_text_counts(spark, docs):
    """A text that turns into another language after its first blocks is judged by all of it."""
    model = cl.fit_languages(docs, dictionary_bytes=8192)
    mixed = text("aa", 1000, 1) + " " + text("bb", 9000, 2)
    df = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert cl.identify_languages(df, model).head().lang_pred == "bb"


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    model = cl.fit_languages(none)
    assert model.dictionaries == {}
    got = cl.identify_languages(docs, model).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} == {"und"}
    assert cl.identify_languages(none, cl.fit_languages(docs)).count() == 0


def test_query_on_held_out_documents(spark, small):
    small = small.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in language_queries.op10_compression_language(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if rows[d.doc_id].held_out]
    right = sum(rows[d.doc_id].lang_pred == d.lang for d in held)
    assert right >= 0.98 * len(held)


def test_words_are_letters_with_their_marks():
    for text in ("", "\u00bd \u00b2", "\u2167", "12 _ 3", "\u0301", " \u0301 \u093f", "\u0661\u0662"):
        assert cl.normalised(text) == ""
    assert cl.normalised("\u0939\u093f\u0928\u094d\u0926\u0940!") == " \u0939\u093f\u0928\u094d\u0926\u0940 "
    assert cl.normalised("\u0301One2 \u0301 two_Three") == " one two three "
