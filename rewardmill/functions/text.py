"""Text and seeded-randomness helpers. Everything here is a built-in expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, left to right; 0 for a missing text.

    Byte lengths are stored with the text, and texts without the literal are not copied.
    """
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    count = (gone / F.lit(len(needle.encode()))).cast("int")
    return F.when(F.contains(text, F.lit(needle)), count).otherwise(F.lit(0))


def seeded_key(seed: int, *row_key: Column) -> Column:
    """A pseudo-random order key that depends only on the seed and the row's own key."""
    parts = [F.lit(str(seed))] + [c.cast("string") for c in row_key]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def seeded_int(seed: int, low: int, high: int, *row_key: Column) -> Column:
    """Uniform integer in [low, high] from 28 bits of the seeded key."""
    if high < low:
        raise ValueError(f"empty range [{low}, {high}]")
    bits = F.conv(F.substring(seeded_key(seed, *row_key), 1, 7), 16, 10).cast("bigint")
    return (F.lit(low) + F.pmod(bits, F.lit(high - low + 1))).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def of_columns(build: Callable[..., Column], *names: str) -> Column:
    """``build`` of the named columns, put together once per JVM and then reused.

    A large expression takes thousands of calls between Python and the JVM; every query and every micro-batch would repeat
    them. ``build`` must be a function of a module, and of its columns alone.
    """
    return _built(SparkContext._gateway, build, names)


@lru_cache(maxsize=256)
def _built(gateway: object, build: Callable[..., Column], names: tuple[str, ...]) -> Column:
    return build(*[F.col(n) for n in names])
