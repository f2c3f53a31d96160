"""What is done with mined itemsets: (items, freq) with items in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import patterns


def unite(*results: DataFrame) -> DataFrame:
    """Itemsets of several results; supports of equal ones are added."""
    column = results[0].columns[0]
    out = results[0].select(column, "freq")
    for other in results[1:]:
        out = out.unionByName(other.select(column, "freq"))
    return out.groupBy(column).agg(F.sum("freq").alias("freq"))


def unite_counts(*results: DataFrame) -> int:
    """Rows of all results, equal itemsets counted each time."""
    return sum(r.count() for r in results)


def by_size(result: DataFrame) -> DataFrame:
    """Longest first, then by text."""
    return result.orderBy(F.desc(F.size("items")), patterns.text(F.col("items"), F.col("freq")))


def by_frequency(result: DataFrame) -> DataFrame:
    """Most frequent first, then longest, then by text."""
    return result.orderBy(F.desc("freq"), F.desc(F.size("items")), patterns.text(F.col("items"), F.col("freq")))


def by_freq(result: DataFrame, key: str = "items", ascending: bool = False) -> DataFrame:
    return result.orderBy(F.asc("freq") if ascending else F.desc("freq"), key)


def by_prefix(result: DataFrame, column: str = "itemset") -> DataFrame:
    """Itemsets that share all but the last item together, in order."""
    return result.orderBy(F.slice(column, F.lit(1), F.size(column) - 1), F.element_at(column, -1))


def top(result: DataFrame, n: int) -> DataFrame:
    return by_freq(result).limit(n)


def first(result: DataFrame, n: int) -> DataFrame:
    return result.limit(n)


def of_length(result: DataFrame, n: int) -> DataFrame:
    return result.where(F.size("items") == n)


def containing(result: DataFrame, *items: str) -> DataFrame:
    return result.where(patterns.contains_items(F.col("items"), *items))


def level_counts(result: DataFrame) -> DataFrame:
    return result.groupBy(F.size("items").alias("k")).agg(F.count("*").alias("n"))


def flat(result: DataFrame) -> DataFrame:
    """(itemset, k, freq) with items joined by commas."""
    return result.select(F.array_join(F.array_sort("items"), ",").alias("itemset"), F.size("items").alias("k"), "freq")


def local(result: DataFrame) -> list:
    """Rows on the driver, fetched a partition at a time; for small results."""
    return list(result.toLocalIterator())
