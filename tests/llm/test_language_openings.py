from rewardmill.llm import compression_lang as cl
from test_compression_lang import WORDS, text

OPENING = " ".join(f"shared{chr(97 + n % 26)}{chr(97 + n // 26)} banner" for n in range(60))


def test_spread_takes_pieces_of_all_of_a_text():
    parts = [bytes([97 + n]) * 1000 for n in range(4)]
    got = cl.spread(b"".join(parts), 256)
    assert len(got) <= 256 and all(got.count(p[:1]) > 30 for p in parts)
    assert cl.spread(b"short", 5) == b"short" and cl.spread(b"x" * 10, 0) == b""
    assert cl.spread("é".encode() * 1000, 301).decode()


def test_documents_with_one_long_opening(spark):
    """All training texts begin alike, and their shares are shorter than the opening."""
    rows = [(i, OPENING + " " + text(lang, 600, i), lang) for i, lang in enumerate(list(WORDS) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = cl.fit_languages(docs, sampled=40, dictionary_bytes=8192)
    for lang, words in WORDS.items():
        held = model.dictionaries[lang].decode()
        assert sum(held.count(w) for w in words) > 200
    new = spark.createDataFrame([(1, text("aa", 60, 901), "aa"), (2, text("bb", 60, 902), "bb"), (3, text("cc", 60, 903), "cc")], docs.schema)
    got = cl.identify_languages(new, model).collect()
    assert all(r.lang_pred == r.lang and not r.rejected for r in got)
