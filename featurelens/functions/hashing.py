"""Seeded draws as Column expressions.

Every draw is a pure function of (seed, row identity), so it does not depend on
partitioning, task order or retries. Keys are md5 hex strings: their first fifteen
digits make a uniform 60-bit integer that sorts the same way the key does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_DIGITS = 15
#: Bits of a word that a double in [0, 1) keeps.
UNIFORM_BITS = 52


def seeded_key(seed, *parts) -> Column:
    """md5 of ``seed-part-part-...``; strings name columns."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def draw_word(key: Column, word: int = 0) -> Column:
    """The ``word``-th unsigned 60-bit integer of a key, as bigint.

    A key holds two; later ones come from the key's own md5 with the number.
    """
    if word > 1:
        key, word = F.md5(F.concat(key, F.lit(f"-{word}"))), 0
    return F.conv(F.substring(key, WORD_DIGITS * word + 1, WORD_DIGITS), 16, 10).cast("bigint")


def draw_uniform(key: Column, word: int = 0) -> Column:
    """A double in [0, 1), non-decreasing in the key for word 0."""
    return F.shiftright(draw_word(key, word), 4 * WORD_DIGITS - UNIFORM_BITS) / F.lit(float(1 << UNIFORM_BITS))


def draw_below(key: Column, bound, word: int = 0) -> Column:
    """An integer in [0, bound)."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return draw_word(key, word) % bound.cast("bigint")
