"""Subsets of index sets, and itemsets that stand for many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subsets of more members would not have 64-bit numbers.
MOST = 62


def number_of_subsets(n: int) -> int:
    if not 0 <= n <= MOST:
        raise ValueError(f"between 0 and {MOST} members are allowed, not {n}")
    return 1 << n


def masks(n: Column) -> Column:
    """Numbers of all subsets of n members."""
    return F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1)


def members(items: Column, mask: Column) -> Column:
    """The members whose bits are set, in their order."""
    return F.filter(items, lambda x, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def subsets(df: DataFrame, items: str, size: int | None = None, to: str = "subset") -> DataFrame:
    """A row for each subset of the array column, or each of a given size."""
    if size is not None and size < 0:
        raise ValueError(f"negative size {size}")
    numbers = masks(F.size(items))
    if size is not None:
        numbers = F.filter(numbers, lambda m: F.bit_count(m) == size)
    return df.withColumn("_mask", F.explode(numbers)).withColumn(to, members(F.col(items), F.col("_mask"))).drop("_mask")


def expand(closed: DataFrame) -> DataFrame:
    """(itemset, freq) from (base, equiv, freq): the base with each subset of
    its equivalent items, which all have its frequency."""
    own = F.array_except("equiv", "base")
    return (
        closed.select("base", own.alias("equiv"), "freq")
        .withColumn("_mask", F.explode(masks(F.size("equiv"))))
        .select(F.array_sort(F.concat("base", members(F.col("equiv"), F.col("_mask")))).alias("itemset"), "freq")
    )


def expanded_count() -> Column:
    """How many rows ``expand`` would make, as an aggregate over its input."""
    each = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(F.array_except("equiv", "base")))
    return F.coalesce(F.sum(each), F.lit(0).cast("long"))
