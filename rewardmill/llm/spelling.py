"""Spelling variant grouping: words, their near words by the gram index, their forms and roots."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardmill.llm import gram_index
from rewardmill.llm.common import map_batches, pieces, stored
from rewardmill.llm.gram_index import MIN_LENGTH, SHORTEST, Dictionary, coded, grams, longest_gram
from rewardmill.llm.tokens import ragged

#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: A gram is frequent from this rate on, and at most so many are; each has at most one longer gram for each of 91 signs,
#: so the dictionary that every task is sent has a fixed bound.
FREQUENT, MOST_FREQUENT = 100, 50_000
#: Words of a list that a task compares with each other; a list that can be longer is dealt out in pairs of blocks.
BLOCK = 1 << 16
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PAIRS = 1 << 19


def runs_of(text: str) -> Counter:
    """Maximal runs of Latin letters with their numbers; only A-Z become lower case."""
    return Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))


def word_counts(docs: DataFrame, change: Callable[[str, int], str] | None = None, id_column: str = "doc_id") -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` signs with at least two occurrences in the texts of ``docs``.

    ``change(run, state)`` may replace a run; ``state`` is the checksum of ``<id>:`` to go on from. A null
    text has no words, a null id is empty. Counts are added up in each task before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    state = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in runs_of(text or "").items():
                        word = change(run, state) if change else run
                        if len(word) >= MIN_LENGTH:
                            total[word] += n
                    if len(total) >= COUNTED:
                        yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), "text")
    return map_batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 2")


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the words of each length, in pieces of at most a million signs."""
    lengths = np.fromiter(map(len, words), "i8", len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // length)
        for at in range(0, len(rows), step):
            yield length, rows[at : at + step]


def gram_counts(words: DataFrame) -> DataFrame:
    """(size, gram, n): how often each gram stands in ``words``, up to the longest that a word can use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {}
            listed = batch.column("word").to_pylist()
            for length, rows in _by_length(listed):
                signs = coded([listed[r] for r in rows])
                for size, keys in grams(signs, longest_gram(length)).items():
                    found.setdefault(size, []).append(keys.ravel())
            for size, keys in found.items():
                gram, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), size, "i4")), pa.array(gram), pa.array(n)], ["size", "gram", "n"])

    return map_batches(words.select("word"), count, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame) -> Dictionary:
    """All shortest grams, and every extension of a frequent gram that is itself in the dictionary.

    Grams no longer than their beginnings' rate allows: a rare beginning is not prolonged. What
    reaches the driver is bounded by ``MOST_FREQUENT`` and the number of signs.
    """
    counts = stored(gram_counts(words), "grams")
    frequent = counts.filter((F.col("n") >= FREQUENT) & (F.col("size") < gram_index.LONGEST)).orderBy(F.desc("n"), "size", "gram").limit(MOST_FREQUENT)
    frequent = frequent.select((F.col("size") + 1).alias("size"), F.col("gram").alias("begins"))
    longer = counts.withColumn("begins", F.shiftright("gram", 7)).join(frequent, ["size", "begins"], "left_semi")
    kept = counts.filter(F.col("size") == SHORTEST).unionByName(longer.select("size", "gram", "n")).toArrow()
    sizes, keys, n = (kept.column(c).to_numpy() for c in ("size", "gram", "n"))
    # A beginning can be frequent only where what it begins with is, so the rates alone give whole chains but for ties at the limit.
    return Dictionary(sizes, keys, n)


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    x = np.uint64(0x9E3779B97F4A7C15)
    for part in parts:
        x = (np.asarray(part).astype("u8") ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB)


def _entries(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(unit, packed, word): a row for each list that a word is in.

    A list holds words of ``length`` and ``length + 1`` signs that have a gram at one distance from the
    start (or, lowest bit of ``unit``, from the end). ``unit`` has the length in its upper bits. ``packed``
    is the word's n with three marks: longer word, later block, unit of two blocks.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            listed, counted = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, rows in _by_length(listed):
                signs = coded([listed[r] for r in rows])
                own = _mixed(*np.ascontiguousarray(signs[:, 1:-1]).T) if length else np.zeros(len(rows), "u8")
                for long in (0, 1):
                    short = length - long
                    if short < MIN_LENGTH:
                        continue
                    row, gram, place = dictionary.rarest(signs, longest_gram(short))
                    # No list is longer than its gram is frequent.
                    blocks = -(-dictionary.rate(gram) // BLOCK)
                    mine = (own[row] % np.maximum(blocks, 1).astype("u8")).astype("i8")
                    at = np.repeat(np.arange(len(row)), np.maximum(blocks, 1))
                    other = ragged(np.zeros(len(row), "i8"), np.maximum(blocks, 1))
                    low, high = np.minimum(mine[at], other), np.maximum(mine[at], other)
                    marks = long | ((mine[at] > other) << 1) | ((low != high) << 2)
                    for from_end in (0, 1):
                        # Two words of one length are compared in the lists by start alone.
                        where = (length + 1 - place) if from_end else place
                        mix = _mixed(gram[at], where[at], low, high)
                        unit = (np.uint64(min(short, 127)) << np.uint64(56)) | (mix >> np.uint64(9) << np.uint64(1)) | np.uint64(from_end)
                        chosen = rows[row[at]]
                        packed = (counted[chosen] << 3) | marks
                        yield pa.RecordBatch.from_arrays([pa.array(unit.view("i8")), pa.array(packed), pa.array([listed[c] for c in chosen], pa.string())], ["unit", "packed", "word"])

    return map_batches(words.select("word", "n"), index, "unit long, packed long, word string")


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array([w.encode("latin-1") for w in words], f"S{width}").view("u1").reshape(len(words), width)


def _are_near(short: np.ndarray, other: np.ndarray, inserted: bool) -> np.ndarray:
    """Whether rows differ by exactly one sign: replaced, or inserted in the other (which has a column more)."""
    if not inserted:
        return (short != other).sum(axis=1) == 1
    size = short.shape[1]
    first = other[:, :size] != short
    after = other[:, 1:] != short
    ahead = np.where(first.any(axis=1), first.argmax(axis=1), size)
    behind = np.where(after.any(axis=1), size - after[:, ::-1].argmax(axis=1), 0)
    return ahead >= behind


def near_in_units(unit: np.ndarray, packed: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows a and b that are near, for whole units in ascending order."""
    long, later, crossing = packed & 1, (packed >> 1) & 1, (packed >> 2) & 1
    order = np.lexsort((long, unit))
    lengths = np.fromiter(map(len, words), "i8", len(words))[order]
    unit, long, later, crossing = unit[order], long[order].astype(bool), later[order], crossing[order]
    firsts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    ends = np.append(firsts[1:], len(unit))
    of = np.repeat(np.arange(len(firsts)), ends - firsts)
    longs = ends - np.add.reduceat(long.astype("i8"), firsts)
    row = np.flatnonzero(~long)
    from_end = (unit[row] & 1).astype(bool)
    begin = np.where(from_end, longs[of[row]], row + 1)
    many = ends[of[row]] - begin
    row, begin, many = row[many > 0], begin[many > 0], many[many > 0]
    out_a, out_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for length in np.unique(lengths[row]).tolist():
        here = np.flatnonzero(lengths[row] == length)
        some = np.flatnonzero((lengths == length) | (lengths == length + 1))
        texts = _matrix([words[order[s]] for s in some], length + 1)
        place = np.zeros(len(lengths), "i8")
        place[some] = np.arange(len(some))
        letters = np.bitwise_or.reduce(np.where(texts, np.uint64(1) << (texts % 64).astype("u8"), np.uint64(0)), axis=1)
        total = np.cumsum(many[here])
        room = max(1024, _PAIRS // max(1, length // 16))
        at = 0
        while at < len(here):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, "right")))
            part = here[at:stop]
            i, j = np.repeat(row[part], many[part]), ragged(begin[part], many[part])
            # Words one edit apart have at most so many letters that only one of them has.
            apart = np.bitwise_count(letters[place[i]] ^ letters[place[j]]) <= np.where(long[j], 1, 2)
            apart &= (crossing[i] == 0) | (later[i] != later[j])
            apart &= lengths[j] == length + long[j]
            i, j = i[apart], j[apart]
            for inserted in (False, True):
                x, y = i[long[j] == inserted], j[long[j] == inserted]
                near = _are_near(texts[place[x], :length], texts[place[y], : length + inserted], inserted)
                out_a.append(order[x[near]])
                out_b.append(order[y[near]])
            at = stop
    return np.concatenate(out_a), np.concatenate(out_b)


def near_links(words: DataFrame, partitions: int | None = None) -> DataFrame:
    """(a, b, n_a, n_b): each pair of near words of ``words`` (word, n; distinct, at least ``MIN_LENGTH`` signs) once.

    Near: one sign (code point) inserted, deleted or replaced. Every list of the index is compared in a task,
    a long one as pairs of blocks.
    """
    dictionary = gram_dictionary(words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.RecordBatch) -> pa.RecordBatch:
            listed, packed = rows.column("word").to_pylist(), rows.column("packed").to_numpy()
            a, b = near_in_units(rows.column("unit").to_numpy().view("u8"), packed, listed)
            pairs = {(listed[x], listed[y]) if listed[x] < listed[y] else (listed[y], listed[x]): (x, y) if listed[x] < listed[y] else (y, x) for x, y in zip(a.tolist(), b.tolist())}
            n = packed >> 3
            x, y = (np.array([p[side] for p in pairs.values()], "i8") for side in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(n[x]), pa.array(n[y])], ["a", "b", "n_a", "n_b"]
            )

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 1 << 17:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            unit = rows.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1], "left"))
            if cut:
                yield found(rows.slice(0, cut))
            held, size = [rows.slice(cut)], rows.num_rows - cut
        if size:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    entries = _entries(words, dictionary)
    dealt = entries.repartition(partitions, "unit") if partitions else entries.repartition("unit")
    links = map_batches(dealt.sortWithinPartitions("unit"), compare, "a string, b string, n_a long, n_b long")
    return links.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def variant_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """``words`` (word, n; distinct) with form, root, n_near and form_n.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least
    ``times`` the word's own, else null; ``root`` is the last word that forms lead to, or the word itself;
    ``n_near`` is the number of near words. No form leads back, since n grows by ``times`` with
    every step, and the steps to the root are few. Other columns are not handed on.
    """
    words = words.select("word", "n")
    links = near_links(words)
    ends = [F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]
    both = links.select(F.inline(F.array(*ends)))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    seen = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best)
    large = -F.col("best.order") >= F.col("n") * times
    seen = stored(
        seen.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.order")).alias("form_n")), "near-words"
    )
    forms = seen.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    roots = forms
    while True:
        # Each round doubles the way that is done.
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nexts = stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = nexts.select("word", "root")
        if nexts.filter("moved").isEmpty():
            break
    return (
        words.join(seen, "word", "left").join(roots, "word", "left")
        .select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
