"""Predicates and text forms of itemsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_items(items: Column, *wanted: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), items)) == 0


def starts_with(items: Column, prefix: Column) -> Column:
    return F.slice(items, 1, F.size(prefix)) == prefix


def common_prefix(a: Column, b: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return (F.size(a) >= n) & (F.size(b) >= n) & (F.slice(a, 1, n) == F.slice(b, 1, n))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def text(items: Column, freq: Column) -> Column:
    """``FI: [a, b]: n`` with items in string order."""
    return F.concat(F.lit("FI: "), listed(F.array_sort(items)), F.lit(": "), freq.cast("string"))


def text_with_ranks(items: Column, ranks: Column, freq: Column, longest: int) -> Column:
    """Items, their ranks and the ranks in order, in padded columns wide
    enough for itemsets of ``longest`` items.  ``ranks`` follow the items."""
    wide, narrow = int(longest * 4.5 + 2), int(longest * 3.5 + 2)
    as_text = ranks.cast("array<string>")
    in_order = F.array_sort(ranks).cast("array<string>")

    def padded(x: Column, n: int) -> Column:
        return F.when(F.length(x) >= n, x).otherwise(F.rpad(x, n, " "))

    return F.concat(
        padded(listed(items), wide), F.lit(" "), padded(listed(as_text), narrow), F.lit(" "), padded(listed(in_order), narrow), F.lit(": "), freq.cast("string")
    )
