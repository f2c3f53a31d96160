"""Bitsets in arrays of 64-bit words, as Column expressions.

Bit ``i`` of a bitset whose words begin at index ``start`` is bit ``i % 64`` of
word ``start + i / 64``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def words_for(bits: int, start: int = 0) -> int:
    """Words that hold the given number of bits, with those before the start."""
    return start + (bits + WORD - 1) // WORD


def total_bits(words: Column, start: int = 0) -> Column:
    return (F.size(words) - start) * WORD


def word_index(bit: int, start: int = 0) -> int:
    return start + bit // WORD


def word_start(bit: Column) -> Column:
    """The first bit of the word that holds a bit."""
    return bit - F.pmod(bit, F.lit(WORD))


def empty(bits: int, start: int = 0) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), words_for(bits, start))


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(WORD)).cast("int"))


def get(words: Column, bit: Column, start: int = 0) -> Column:
    return F.get(words, (F.lit(start) + F.floor(bit / WORD)).cast("int")).bitwiseAND(_mask(bit)) != 0


def set_bit(words: Column, bit: Column, start: int = 0) -> Column:
    at = (F.lit(start) + F.floor(bit / WORD)).cast("int")
    return F.transform(words, lambda w, i: F.when(i == at, w.bitwiseOR(_mask(bit))).otherwise(w))


def set_all(words: Column, bits: Column, start: int = 0) -> Column:
    return F.aggregate(bits, words, lambda s, b: set_bit(s, b, start))


def own(words: Column, start: int = 0) -> Column:
    """The words of the bitset itself."""
    return F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))


def cardinality(words: Column, start: int = 0) -> Column:
    return F.aggregate(own(words, start), F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))


def as_numbers(words: Column, start: int = 0) -> Column:
    """The set bits, ascending."""
    some = F.sequence(F.lit(0).cast("long"), F.greatest(total_bits(words, start), F.lit(1)).cast("long") - 1)
    return F.filter(some, lambda b: F.coalesce(get(words, b, start), F.lit(False)))


def word_numbers(words: Column, word: int, start: int = 0) -> Column:
    """The set bits in one word."""
    base = (word - start) * WORD
    return F.filter(F.sequence(F.lit(base).cast("long"), F.lit(base + WORD - 1).cast("long")), lambda b: get(words, b, start))


def lowest(words: Column, start: int = 0) -> Column:
    """The least set bit, -1 if there is none."""
    return F.coalesce(F.array_min(as_numbers(words, start)), F.lit(-1).cast("long"))


def highest(words: Column, start: int = 0) -> Column:
    return F.coalesce(F.array_max(as_numbers(words, start)), F.lit(-1).cast("long"))


def is_zero(words: Column, start: int = 0) -> Column:
    return F.forall(own(words, start), lambda w: w == 0)


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("long")).bitwiseAND(F.coalesce(y, F.lit(0).cast("long"))))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("long")).bitwiseOR(F.coalesce(y, F.lit(0).cast("long"))))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(F.coalesce(y, F.lit(0).cast("long")))))


def same(a: Column, b: Column) -> Column:
    """Bits in which two bitsets agree, over all of their words."""
    return F.zip_with(a, b, lambda x, y: F.bitwise_not(F.coalesce(x, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(y, F.lit(0).cast("long")))))


def flip(words: Column, last: int, start: int = 0) -> Column:
    """Bits up to and with ``last`` turned, later ones kept."""
    at, full = word_index(last, start), (last + 1) % WORD == 0
    low = -1 if full else (1 << ((last + 1) % WORD)) - 1
    part = low - (1 << WORD) if low >= 1 << (WORD - 1) else low

    def turn(w: Column, i: Column) -> Column:
        return (
            F.when((i >= start) & (i < at), F.bitwise_not(w))
            .when(i == at, w.bitwiseXOR(F.lit(part).cast("long")))
            .otherwise(w)
        )

    return F.transform(words, turn)
