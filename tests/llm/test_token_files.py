import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rewardmill.llm import packing, token_files, token_queries

TEXTS = [
    "a  b", " x", "x \n y  z ", " ", "", None, "it's  'tis ok", "<|endoftext|> a", "é ü\n\n x 日本 語 ", " 😀 😀 a", "x ²³ ٣",
    "word " * 5000, "a b", "a b",
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(token_queries.tokenizer_file())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % len(TEXTS), t, "other", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 2), (3, "again", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")


def brute(docs, tokenizer, end_id):
    rows = docs.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    return [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [end_id]) for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**60 - 1) | st.integers(0, 50_256) | st.integers(0, 3), max_size=3000))
def test_pack_round_trip(ids):
    raw = token_files.pack(np.array(ids, "u8"))
    assert token_files.unpack(raw).tolist() == ids
    a, b = len(ids) // 3, len(ids) // 2
    assert token_files.unpack(raw, a, b).tolist() == ids[a:b]


def test_pack_chooses_the_densest_layout():
    ones = token_files.pack(np.ones(600, "u8"))
    assert len(ones) == 8 + 4 + 8 * 10
    with pytest.raises(ValueError):
        token_files.pack(np.array([2**60], "u8"))


def test_files_hold_every_id_in_document_order(spark, docs, tokenizer, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, token_queries.tokenizer_file(), 2)
    got = token_files.read_token_files(spark.read.parquet(path)).orderBy("start").collect()
    want, start = brute(docs, tokenizer, 2), 0
    assert len(got) == len(want)
    for row, (doc_id, ids) in zip(got, want):
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    none = docs.filter("false")
    token_files.write_token_files(none, path, token_queries.tokenizer_file(), 2)
    assert token_files.read_token_files(spark.read.parquet(path)).count() == 0
    assert packing.decompose(none, token_queries.tokenizer_file(), 1).count() == 0


@given(st.integers(1, 10**6), st.sampled_from([1, 2, 64, 2048]))
def test_piece_lengths(n, longest):
    lengths = packing.piece_lengths(n, longest)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= longest for x in lengths)
    assert lengths == sorted(lengths, reverse=True)


def test_decompose_keeps_every_id_once(spark, docs, tokenizer):
    rows = packing.decompose(docs, token_queries.tokenizer_file(), 1, 64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length == 1 << r.bucket == len(r.ids) // 4 and r.offset == 0 for r in rows)
    flat = []
    for r in sorted(rows, key=lambda r: r.sequence_id):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        if r.start == 0:
            flat.append([])
        assert r.start == len(flat[-1])
        flat[-1].extend(ids)
    assert sorted(flat) == sorted(ids for _, ids in brute(docs, tokenizer, 1))


def test_buckets_are_folders(spark, docs, tmp_path):
    path = str(tmp_path / "buckets")
    rows = packing.decompose(docs, token_queries.tokenizer_file(), 1, 64)
    packing.write_buckets(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == rows.count()
    assert back.filter("length != pow(2, bucket)").count() == 0


def test_queries_against_brute_force(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {d: ids for d, ids in brute(docs, tokenizer, 2)}
    start = 0
    got = {r.doc_id: r for r in token_queries.op2_token_files(spark, small).collect()}
    for doc_id, ids in sorted(want.items()):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    pieces = token_queries.op8_power_of_two_packing(spark, small).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for p in pieces:
        ids = [*want[p.doc_id][:-1], 1]
        assert p.doc_tokens == len(ids) and p.length & (p.length - 1) == 0 and p.length <= 2048
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_remembered_parts_stay_bounded_on_both_ways(monkeypatch):
    """Plain texts and texts with double blanks: the memory turns over, and ids stay those of the library."""
    import pyarrow as pa

    from rewardmill.llm import tokens
    from rewardmill.llm.token_queries import tokenizer_file

    monkeypatch.setattr(tokens, "REMEMBERED", 60_000)
    for blanks in (" ", "  "):
        coder = tokens.Encoder(tokenizer_file())
        for turn in range(12):
            words = [f"part{turn}x{i}" for i in range(200)] + ["common"] * 3 + ["l" * 500]
            texts = [" ".join(words), f"a{blanks}b " + " ".join(words)]
            ids, counts = coder.encode(pa.array(texts if blanks == " " else texts[1:]))
            want = [e.ids for e in coder.tokenizer.encode_batch_fast(texts if blanks == " " else texts[1:], add_special_tokens=False)]
            assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
            assert len(coder.inner) + len(coder.older) < 600
            assert not any(len(w) > 64 for w in coder.inner)


@pytest.mark.parametrize("seed", range(3))
def test_places_of_a_walk(seed):
    steps = np.random.default_rng(seed).integers(1, 9, 500)
    places, at = [], 0
    while at < len(steps):
        places.append(at)
        at += int(steps[at])
    assert token_files._reached(steps).tolist() == places
    assert token_files._reached(steps[:0]).tolist() == []
