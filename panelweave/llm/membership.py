"""Bloom filters as DataFrames: rows of 64-bit words, built by grouped aggregates and tested by broadcast joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A filter has at most 2^MAX_BITS slots, so at most 2^(MAX_BITS - 6) words (about 64 MB) are ever broadcast.
# With more rows than that serves, more rows pass the filter and are shuffled; no result depends on it.
MAX_BITS = 27
SLOTS_PER_ROW = 16


def filter_bits(rows: int) -> int:
    """log2 of the slots for a filter over `rows` hashes."""
    return max(10, min(MAX_BITS, (SLOTS_PER_ROW * rows).bit_length()))


def filter_words(hashes: DataFrame, column: str, bits: int, at_least: int = 1) -> DataFrame:
    """The filter (word, bits) of slots that at least `at_least` hashes fall into.

    With `at_least=2` it is the filter of possibly repeated hashes: equal hashes meet in both of their slots.
    """
    slots = hashes.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    return counted.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def with_membership(rows: DataFrame, column: str, words: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add the boolean `flag`: false only where the hash in `column` is surely not in the filter. No row is shuffled."""
    found = F.lit(True)
    names = list(rows.columns)
    for i, slot in enumerate(_slots(F.col(column), bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"__word{i}"), F.col("bits").alias(f"__bits{i}")))
        rows = rows.join(side, F.shiftright(slot, 6) == F.col(f"__word{i}"), "left")
        found = found & (F.getbit(F.coalesce(f"__bits{i}", F.lit(0)), slot.bitwiseAND(63).cast("int")) == 1)
    return rows.select(*[F.col(f"`{n}`") for n in names], found.alias(flag))


def _slots(value: Column, bits: int) -> list[Column]:
    """Two slots from the low and the high bits of a 64-bit hash."""
    mask = F.lit((1 << bits) - 1)
    return [value.bitwiseAND(mask), F.shiftrightunsigned(value, 64 - bits).bitwiseAND(mask)]
