"""Register-blocked Bloom filters as small frames of (word, bits), in DataFrame operations only.

A hash names one 64-bit word of the filter and two bits of it. A filter has a row for each word that
is not empty and at most `most_words` of them, so its size is bounded and it can be broadcast; the
more hashes it holds, the more others it lets pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 22
LEAST_WORDS = 1 << 10


def filter_words(rows: int, most_words: int = MOST_WORDS) -> int:
    """Words of a filter: a power of two, about half the rows, within the bounds."""
    return min(most_words, max(LEAST_WORDS, 1 << max(0, rows // 2).bit_length()))


def _bit(hashed: Column, shift: int) -> Column:
    place = F.shiftrightunsigned(hashed, shift).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def cell(hashed: Column, words: int) -> tuple[Column, Column]:
    """(word, mask) of a 64-bit hash."""
    return hashed.bitwiseAND(words - 1), _bit(hashed, 40).bitwiseOR(_bit(hashed, 52))


def filled(cells: DataFrame) -> DataFrame:
    """(word, bits) of (word, mask)."""
    return cells.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def held(bits: Column, mask: Column) -> Column:
    """False only if the filter does not hold the cell."""
    return F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False))


def tried(frame: DataFrame, key: Column, members: DataFrame, member: Column, most_words: int = MOST_WORDS) -> DataFrame:
    """(row, key, maybe) of `frame`: `maybe` is true if the key may be a member, for sure if it is one.

    `frame` is not shuffled.
    """
    words = filter_words(members.count(), most_words)
    word, mask = cell(F.xxhash64(member), words)
    table = filled(members.select(word.alias("word"), mask.alias("mask")))
    word, mask = cell(F.xxhash64("key"), words)
    keyed = frame.select(F.struct("*").alias("row"), key.alias("key")).withColumns({"word": word, "mask": mask})
    return keyed.join(F.broadcast(table), "word", "left").select(
        "row", "key", held(F.col("bits"), F.col("mask")).alias("maybe")
    )
