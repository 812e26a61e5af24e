"""Spelling variants by a variable-length gram index.

Grams are counted over all words. The dictionary holds every extension of a frequent
gram, so frequent beginnings grow longer and rare ones stay short. A word between
two marks is cut into the longest dictionary gram at every place, less those that
lie inside an earlier one. For every place of one edit it is known which of its grams
the edit can touch: those across the place, those before it that the dictionary
could have prolonged over it, and those behind it that a prolonged gram could have
swallowed. The most that any edit touches is the word's bound: two words one edit
apart share all but that many of its grams. So they share one of its ``bound + 1``
rarest, at the same distance from the start or from the end, and only these are indexed.

The longest gram depends on the length of the word: half of it, so that no edit can
touch both the first gram and the last, and every word of ``MIN_LENGTH`` has at least one shared gram.
"""

from __future__ import annotations

import numpy as np

MIN_LENGTH, SHORTEST = 7, 2
#: Longest gram of any word; eight signs of seven bits fit a long.
LONGEST = 8
_BITS = 7
# Signs: 1 and 2 are the marks, then a-z and the Latin letters from U+00C0.
FIRST, LAST = 1, 2


def longest_gram(length: int) -> int:
    """The longest gram of words of ``length`` and ``length + 1`` signs."""
    return min(LONGEST, (length + 2) // 2)


def coded(words: list[str]) -> np.ndarray:
    """Words of one length as rows of signs between two marks."""
    points = np.array(words).view("u4").reshape(len(words), -1)
    out = np.empty((len(words), points.shape[1] + 2), "i8")
    out[:, 0], out[:, -1] = FIRST, LAST
    out[:, 1:-1] = np.where(points < 0xC0, points.astype("i8") - 94, points.astype("i8") - 163)
    return out


def grams(signs: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """For each gram length the grams at all places, as numbers."""
    out, keys = {}, signs
    for size in range(2, longest + 1):
        keys = (keys[:, :-1] << _BITS) | signs[:, size - 1 :]
        out[size] = keys
    return out


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(keys.shape, bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


class Dictionary:
    """The grams of each length with their frequencies, and what the bounds need to know of them."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = {}, {}
        for size in range(SHORTEST, LONGEST + 1):
            order = np.flatnonzero(sizes == size)
            order = order[np.argsort(keys[order], kind="stable")]
            self.keys[size], self.counts[size] = keys[order], counts[order]
        # Prefixes that a longer gram begins with.
        self.begins = {size: np.unique(self.keys[size + 1] >> _BITS) for size in range(SHORTEST, LONGEST)}
        self._inner: dict[int, dict[int, np.ndarray]] = {}

    def inner(self, longest: int) -> dict[int, np.ndarray]:
        """What grams of at most ``longest`` signs hold behind their first sign, by length."""
        if longest not in self._inner:
            found = {}
            for size in range(SHORTEST, longest):
                parts = [np.zeros(0, "i8")]
                for whole in range(size + 1, longest + 1):
                    mask = (1 << (_BITS * size)) - 1
                    parts += [(self.keys[whole] >> (_BITS * right)) & mask for right in range(whole - size)]
                found[size] = np.unique(np.concatenate(parts))
            self._inner[longest] = found
        return self._inner[longest]

    def rate(self, grams: np.ndarray) -> np.ndarray:
        """How often each gram stands in the words; 0 for one that is not in the dictionary."""
        out = np.zeros(len(grams), "i8")
        for size, known in self.keys.items():
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                out = np.where(known[at] == grams, self.counts[size][at], out)
        return out

    def decompose(self, signs: np.ndarray, longest: int):
        """For every row and place: last place of the gram there, whether it is one of the word's, and its frequency."""
        n, m = signs.shape
        keys = grams(signs, longest)
        last = np.zeros((n, m - 1), "i4")
        last[:] = np.arange(m - 1) + SHORTEST - 1
        rate = np.zeros((n, m - 1), "i8")
        for size in range(SHORTEST, longest + 1):
            known = self.keys[size]
            if not len(known) or keys[size].shape[1] == 0:
                continue
            at = np.minimum(np.searchsorted(known, keys[size]), len(known) - 1)
            hit = known[at] == keys[size]
            width = keys[size].shape[1]
            last[:, :width] = np.where(hit, np.arange(width) + size - 1, last[:, :width])
            rate[:, :width] = np.where(hit, self.counts[size][at], rate[:, :width])
        reach = np.maximum.accumulate(last, axis=1)
        held = np.ones((n, m - 1), bool)
        held[:, 1:] = last[:, 1:] > reach[:, :-1]
        return keys, last, held, rate

    def bounds(self, signs: np.ndarray, longest: int, keys: dict[int, np.ndarray], last: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The most grams of each word that one replaced, deleted or inserted sign can touch."""
        n, m = signs.shape
        inner = self.inner(longest)
        begins = {size: _among(keys[size], self.begins[size]) for size in range(SHORTEST, longest)}
        swallowed = {size: _among(keys[size], inner[size]) for size in range(SHORTEST, longest)}
        most = np.zeros(n, "i8")
        for i in range(1, m):
            # No gram further off is touched.
            window = slice(max(0, i - longest + 1), min(m - 1, i + longest + 1))
            place = np.arange(window.start, window.stop)
            mine, end = held[:, window], last[:, window]
            # From here on a gram before place i can change.
            since = np.full(n, m, "i4")
            for size in range(SHORTEST, longest):
                if i - size >= 0:
                    since = np.where(begins[size][:, i - size], i - size, since)
            before = (end < i) & (place >= since[:, None])
            # The sign at i is replaced or deleted (not a mark), or one is inserted before it.
            kinds = [(i, (place < i) & (end >= i))] + ([(i + 1, (place <= i) & (end >= i))] if i < m - 1 else [])
            for start, across in kinds:
                until = np.full(n, -1, "i4")
                for size in range(SHORTEST, longest):
                    if start + size <= m:
                        until = np.where(swallowed[size][:, start], start + size - 1, until)
                behind = (place >= start) & (end <= until[:, None])
                most = np.maximum(most, (mine & (across | before | behind)).sum(axis=1))
        return most

    def rarest(self, signs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, gram and place of each word's ``bound + 1`` rarest grams."""
        keys, last, held, rate = self.decompose(signs, longest)
        wanted = self.bounds(signs, longest, keys, last, held) + 1
        n, m = signs.shape
        gram = np.zeros((n, m - 1), "i8")
        for size in range(SHORTEST, longest + 1):
            width = keys[size].shape[1]
            own = last[:, :width] - np.arange(width) + 1 == size
            gram[:, :width] = np.where(own, keys[size], gram[:, :width])
        place = np.broadcast_to(np.arange(m - 1), gram.shape)
        order = np.lexsort((place, gram, np.where(held, rate, np.iinfo("i8").max)), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, place, axis=1)
        rows, at = np.nonzero(held & (rank < wanted[:, None]))
        return rows, gram[rows, at], at
