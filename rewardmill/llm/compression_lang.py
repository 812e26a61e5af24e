"""Language identification by compression.

Every language is a dictionary: raw text of that language, which zstandard may
refer back to. A text is compressed with each dictionary, block by block, and
has the language whose dictionary makes it smallest. The margin is how much
smaller than with the next best one; texts with a narrow margin are rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rewardmill.llm.common import map_batches, pieces

UNKNOWN = "und"
#: Documents per language whose texts may enter its dictionary, and bytes of a dictionary.
SAMPLED = 200
DICTIONARY_BYTES = 48 * 1024
#: Bytes of the pieces by which a text enters that is longer than its share.
PIECE = 64
#: Bytes that are compressed at a time, so that all of a long text is measured against the dictionary.
BLOCK = 4096
#: Blanks after every block. A compressor stores a block as it is when it saves too little; these always save enough.
_TAIL = b" " * 64
# What is neither a letter nor a mark on one; a run of marks alone is no word.
_OTHER = regex.compile(r"(?:[^\p{L}\p{M}]++\p{M}*+)++|\A\p{M}++")


def normalised(text: str) -> str:
    """Lower-case words (letters with their marks) with single blanks between them and around; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


@dataclass
class LanguageModel:
    """Dictionary text by language, at most ``DICTIONARY_BYTES`` each, and the number of its training rows."""

    dictionaries: dict[str, bytes]
    rows: dict[str, int] = field(default_factory=dict)

    def names(self) -> list[str]:
        """Languages, those with most training rows first: of equal sizes the first one wins."""
        return sorted(self.dictionaries, key=lambda lang: (-self.rows.get(lang, 0), lang))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """One for every language, in the order of ``names``."""
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY, window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4,
            target_length=16, write_content_size=False, write_dict_id=False,
        )
        made = []
        for lang in self.names():
            held = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))
        return made


def is_training(doc_id: Column) -> Column:
    """Rows a model may learn from; the rest is held out. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def spread(text: bytes, room: int) -> bytes:
    """At most ``room`` bytes of a normalised text: the whole, or pieces from the middles of equal parts of it."""
    if len(text) <= room:
        return text
    n = max(1, room // PIECE)
    width = room // n
    starts = [(2 * i + 1) * len(text) // (2 * n) - width // 2 for i in range(n)]
    # The last byte of each piece is a blank, so that pieces do not join into one word.
    return b"".join(text[max(0, at) : max(0, at) + width - 1].decode(errors="ignore").encode() + b" " for at in starts if width)


def fit_languages(docs: DataFrame, sampled: int = SAMPLED, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """A dictionary for every non-null ``lang`` of ``docs`` (doc_id, text, lang).

    Ids are ranked by a hash within their language, and only the texts of the first
    ``sampled`` of each are read whole: with L languages at most L * ``sampled`` texts come
    to the driver, each thinned by Spark to ``dictionary_bytes`` spread evenly over it. Texts
    share the dictionary evenly; what one leaves over goes to the others. Equal rows count once.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", "lang")
    slots = known.groupBy("lang", F.pmod(order, F.lit(sampled)).alias("slot"))
    per_lang = slots.agg(F.min(F.struct(order.alias("h"), "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    if not per_lang:
        return LanguageModel({})
    chosen, counts = [(r["lang"], r["first"]["doc_id"]) for r in per_lang], {}
    for r in per_lang:
        counts[r["lang"]] = counts.get(r["lang"], 0) + r["n"]
    names = known.sparkSession.createDataFrame(chosen, known.select("lang", "doc_id").schema)
    size = F.length("text")
    # A very long text gives an evenly spaced part of its slices, so that no text can fill the driver.
    part = F.lit(512)
    whole = size <= dictionary_bytes
    spaced = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(dictionary_bytes // 512 - 1)),
            lambda i: F.substring("text", (i * size / F.lit(dictionary_bytes // 512)).cast("int") + 1, part),
        ),
        " ",
    )
    texts = known.join(F.broadcast(names), ["lang", "doc_id"]).select("lang", "doc_id", F.when(whole, F.col("text")).otherwise(spaced).alias("text"))
    by_lang: dict[str, list[bytes]] = {}
    for row in sorted(set(map(tuple, texts.collect()))):
        by_lang.setdefault(row[0], []).append(normalised(row[2]).encode())
    made = {}
    for lang, parts in by_lang.items():
        parts = sorted({p for p in parts if p}, key=lambda p: (len(p), p))
        content, room = [], dictionary_bytes
        for done, p in enumerate(parts):
            content.append(spread(p, room // (len(parts) - done)))
            room -= len(content[-1])
        if b"".join(content).strip():
            made[lang] = b"".join(content)
    return LanguageModel(made, {lang: counts[lang] for lang in made})


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of a normalised text with each dictionary, over all its blocks."""
    raw = text.encode()
    blocks = [raw[at : at + BLOCK] + _TAIL for at in range(0, len(raw), BLOCK)]
    return np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors], "f8")


def identify_languages(docs: DataFrame, model: LanguageModel, margin: float = 0.005) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected; every row comes back.

    ``lang_pred`` is a language of the model, or ``und`` if the text is null or has no letter, or
    the model knows no language. ``score`` (0 to 1) is the margin: the share of the second
    smallest size that the smallest saves. ``rejected`` is true for ``und`` and for a
    score below ``margin``. Of equal sizes the language with most training rows wins, with score 0. Existing columns of
    the three names are replaced.
    """
    names = model.names()
    rest = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*rest.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                found, scores = [], []
                for text in part.column("text").to_pylist():
                    plain = normalised(text or "")
                    if not plain or not names:
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    s = sizes(plain, compressors)
                    best = int(np.argmin(s))
                    other = np.delete(s, best)
                    found.append(names[best])
                    scores.append(float(1 - s[best] / other.min()) if len(other) else 1.0)
                columns = [*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score"])

    predicted = map_batches(rest, predict, schema)
    return predicted.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < margin))
