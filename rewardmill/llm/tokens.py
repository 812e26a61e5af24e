"""Exact bulk encoding with the ``tokenizers`` library.

A byte-level BPE splits text into words first and never merges across them. A
blank before a letter, digit or sign always starts a word, so a text may be cut
there and its parts encoded apart. Parts repeat, so each distinct one goes
through the library once per worker and the ids of whole texts are gathered
from those by array operations.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that a worker spends on remembered parts (about 250 for a usual one), in two generations: when the younger
#: is full it becomes the older, and the older goes but for parts that were used again. Speed only.
REMEMBERED = 160 << 20
#: Longer parts are encoded each time.
_LONG = 64
_JOINED = 100
_CUT = re.compile(r" (?=[\w!-~])")
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder of a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Let all remembered parts go; encoders stay usable."""
    for known in _encoders.values():
        known.inner, known.older, known.spent = {}, {}, 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... of all runs one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """``encode(texts)`` gives the ids of every text, the same as the library's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            # The driver's folder need not be the worker's.
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(path))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, "i8")
        for token, number in vocabulary.items():
            self.widths[number] = len(token)
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spent = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Encode blank + word for many words in one text; token widths in bytes tell where a word ends."""
        out: list[bytes] = []
        for at in range(0, len(words), _JOINED):
            some = [" " + w for w in words[at : at + _JOINED]]
            ids = self._ids(["".join(some)])[0]
            reached = np.cumsum(self.widths[ids])
            ends = np.cumsum([len(w.encode()) for w in some])
            cuts = np.searchsorted(reached, ends)
            if np.array_equal(reached[cuts], ends):
                raw, starts = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
                out += [raw[a:b] for a, b in zip(starts, starts[1:])]
            else:
                out += [x.tobytes() for x in self._ids(some)]
        return out

    def _coded(self, words: list[str]) -> list[bytes]:
        """Ids of blank + word for distinct words, remembered or encoded now."""
        out = list(map(self.inner.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = self.older.get(words[i])
        fresh = [i for i in missing if out[i] is None]
        for i, ids in zip(fresh, self._encoded([words[i] for i in fresh])):
            out[i] = ids
        kept = [i for i in missing if len(words[i]) <= _LONG]
        self.inner.update((words[i], out[i]) for i in kept)
        self.spent += sum(220 + len(words[i]) + len(out[i]) for i in kept)
        if self.spent > REMEMBERED // 2:
            self.inner, self.older, self.spent = {}, self.inner, 0
        return out

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All parts of all texts, each but a text's first without its blank, and the number of each text's parts."""
        split = pc.split_pattern(texts, " ")
        return split.flatten(), np.diff(np.asarray(split.offsets))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each; a null text has none."""
        texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
        if not len(texts):
            return np.zeros(0, "u4"), np.zeros(0, "i8")
        odd = pc.match_substring_regex(texts, r" ([^!-~\pL\pN]|$)|^ |  ").to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd)
        words, counts = self._parts(texts)
        index = words.dictionary_encode()
        distinct = index.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts_at = np.cumsum(counts) - counts
        where = index.indices.to_numpy().astype("i8")
        first = words.take(pa.array(firsts_at)).dictionary_encode()
        where[firsts_at] = len(distinct) + first.indices.to_numpy()
        coded = self._coded(distinct) + [x.tobytes() for x in self._ids(first.dictionary.to_pylist())]
        lengths = np.fromiter(map(len, coded), "i8", len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "u4")
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[where]
        ids = flat[ragged(starts[where], per_word)]
        return ids, np.add.reduceat(per_word, firsts_at)

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a blank that starts no word are cut only at the other blanks."""
        plain_ids, plain_counts = self.encode(texts.filter(pa.array(~odd)))
        rows: list[np.ndarray] = []
        for text in texts.filter(pa.array(odd)).to_pylist():
            head, *rest = _CUT.split(text)
            distinct = list(dict.fromkeys(rest))
            known = dict(zip(distinct, self._coded(distinct)))
            rows.append(np.concatenate([*self._ids([head]), np.frombuffer(b"".join([known[w] for w in rest]), "u4")]))
        counts = np.zeros(len(texts), "i8")
        counts[~odd], counts[odd] = plain_counts, [len(r) for r in rows]
        flat = np.concatenate([plain_ids, *rows]).astype("u4")
        places = np.zeros(len(texts), "i8")
        places[~odd] = np.cumsum(plain_counts) - plain_counts
        places[odd] = len(plain_ids) + np.cumsum(counts[odd]) - counts[odd]
        return flat[ragged(places, counts)], counts
