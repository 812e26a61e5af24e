import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardmill.llm import gram_index, spelling, spelling_queries


def near(word):
    """All that deletes, replaces or inserts one sign, as patterns with the place left open."""
    for i in range(len(word) + 1):
        yield word[:i] + "?" + word[i:]
        if i < len(word):
            yield word[:i] + "?" + word[i + 1 :]


def brute_words(docs):
    out = Counter()
    for doc_id, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute_groups(words):
    found = {}
    for w in words:
        for pattern in near(w):
            found.setdefault(pattern, set()).add(w)
    links = {w: set() for w in words}
    for group in found.values():
        for a in group:
            links[a] |= group - {a}
    # Patterns join a word of length m with the open place inserted and one of m + 1 with it replaced, and words with equal patterns.
    for a in links:
        links[a] = {b for b in links[a] if one_apart(a, b)}
    form = {}
    for a, near_words in links.items():
        if near_words:
            best = min(near_words, key=lambda b: (-words[b], b))
            if words[best] >= 10 * words[a]:
                form[a] = best
    out = {}
    for a, n in words.items():
        root = a
        while root in form:
            root = form[root]
        out[a] = (n, form.get(a), root, len(links[a]), words[form[a]] if a in form else None)
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def result(df):
    return {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()}


def invented(seed, n, alphabet):
    r = random.Random(seed)
    syllables = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 4))) for _ in range(8)]
    words = set()
    while len(words) < n:
        w = "".join(r.choice(syllables) for _ in range(9))[: r.randrange(7, 16)]
        words.add(w)
        if len(w) > 7:
            i = r.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i + 1 :]}
    return {w: r.choice([2, 3, 20, 30, 300, 4000]) for w in sorted(words) if len(w) >= 7}


@pytest.mark.parametrize("seed,alphabet,frequent,block", [(1, "abc", 3, 1 << 16), (2, "ab", 1, 40), (3, "abcdefgé", 10, 16), (4, "aÿ", 5, 300)])
def test_near_words_equal_brute_force(spark, monkeypatch, seed, alphabet, frequent, block):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = invented(seed, 600, alphabet)
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("root", F.lit("clash"))
    assert result(spelling.variant_groups(df)) == brute_groups(words)


@pytest.mark.parametrize("seed", range(4))
def test_no_edit_touches_more_grams_than_the_bound(seed):
    r = random.Random(seed)
    words = list(invented(seed, 300, "abc" if seed % 2 else "abcde"))
    sizes, keys = [], []
    for length in {len(w) for w in words}:
        signs = gram_index.coded([w for w in words if len(w) == length])
        for size, found in gram_index.grams(signs, gram_index.longest_gram(length)).items():
            keys.append(found.ravel())
            sizes.append(np.full(found.size, size))
    both, n = np.unique(np.stack([np.concatenate(sizes), np.concatenate(keys)]), axis=1, return_counts=True)
    frequent = {(int(s), int(k)) for (s, k), c in zip(both.T, n) if c > 4 + seed}
    kept = [i for i, (s, k) in enumerate(both.T) if s == 2 or (int(s) - 1, int(k) >> 7) in frequent]
    dictionary = gram_index.Dictionary(both[0][kept], both[1][kept], n[kept])

    def cut(word, longest):
        signs = gram_index.coded([word])
        keys, last, held, _ = dictionary.decompose(signs, longest)
        bound = dictionary.bounds(signs, longest, keys, last, held)[0]
        return {(int(p), int(last[0, p]), tuple(signs[0, p : last[0, p] + 1].tolist())) for p in np.flatnonzero(held[0])}, int(bound)

    for word in r.sample(words, 60):
        i = r.randrange(len(word) + 1)
        others = [word[:i] + c + word[i:] for c in "ab"] + ([word[:i] + "b" + word[i + 1 :]] if i < len(word) else [])
        for other in others:
            if other == word:
                continue
            longest = gram_index.longest_gram(min(len(word), len(other)))
            (mine, bound), (theirs, other_bound) = cut(word, longest), cut(other, longest)
            shift = len(other) - len(word)
            shared = [g for g in mine if g in theirs or (g[0] + shift, g[1] + shift, g[2]) in theirs]
            assert len(shared) >= max(len(mine) - bound, len(theirs) - other_bound) >= 1


DOCS = [
    (0, "Wonderful wonderful WONDERFUL Étranger étranger ×÷×÷×÷× ×÷×÷×÷×"),
    (1, None), (2, ""), (3, "wonderfull wonderfull short short"), (None, "wanderful wanderful"), (4, "wonderful " * 500), (4, "wonderful " * 500),
    (5, "abcdefgh1abcdefgh_abcdefgh"), (6, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3001),
]


def test_query_on_odd_texts(spark, tmp_path):
    docs = DOCS + [(10 + i, "thermometer barometer chronometer kilometres") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(spelling_queries.op12_spelling_variants(spark, str(tmp_path)))
    assert got == brute_groups(brute_words(docs))
    assert got["wonderfull"][1] == "wonderful"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling_queries.op12_spelling_variants(spark, str(tmp_path)).collect() == []


def test_whole_small_table(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spelling_queries.op12_spelling_variants(spark, small)) == brute_groups(brute_words(docs))
