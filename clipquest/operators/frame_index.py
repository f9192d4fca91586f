"""Compact form of the table of readable frames.

``frame_index(id, idx)`` names every frame the decoder can read. It is the
largest table of a run, so it is reduced once, map side first, to one word of
bits per 60 consecutive frames; everything later joins against the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 60
_FULL = (1 << WORD_BITS) - 1


def word_number(idx: Column) -> Column:
    return F.floor(idx / F.lit(WORD_BITS))


def bit_set(bits: Column, idx: Column) -> Column:
    """Whether the word marks this frame as readable; a missing word does not."""
    place = F.pmod(idx, F.lit(WORD_BITS)).cast("int")
    return F.coalesce(F.getbit(bits, place) == 1, F.lit(False))


def frame_words(frame_index: DataFrame) -> DataFrame:
    """``(id, word, bits)``; repeated frames change nothing.

    Store the result: it is read more than once, and Spark pushes different
    filters into each reading, so it would not share a common scan.
    """
    idx = F.col("idx")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"),
                           F.pmod(idx, F.lit(WORD_BITS)).cast("int"))
    return (frame_index.filter(idx >= 0)
            .groupBy("id", word_number(idx).alias("word"))
            .agg(F.bit_or(mark).alias("bits")))


def readable_prefix(words: DataFrame) -> DataFrame:
    """``(id, readable)``: how many frames can be read from 0 to the first gap.

    The gap lies in the first word that is not full, or after the first full
    word without a successor. Both are found per word, with an evenly spread
    equi-join, and only their minimum is taken per video.
    """
    bits, word = F.col("bits"), F.col("word")
    run_of_ones = F.bit_count(bits.bitwiseAND(F.bitwise_not(bits + 1)))
    inside = words.select(
        "id", "word", F.when(bits != _FULL, word * WORD_BITS + run_of_ones).alias("gap"))
    after_full = (
        words.filter(bits == _FULL).select("id", (word + 1).alias("word"))
        .join(words.select("id", "word"), ["id", "word"], "left_anti")
        .select("id", "word", (word * WORD_BITS).alias("gap")))
    return (inside.unionByName(after_full)
            .groupBy("id").agg(F.min("word").alias("first_word"), F.min("gap").alias("gap"))
            .select("id", F.when(F.col("first_word") == 0, F.col("gap"))
                    .otherwise(F.lit(0).cast("bigint")).alias("readable")))
