"""Numbers of pairs and of itemsets of one size.

An itemset of k items is a pair of an item and the number of an itemset of
k - 1; numbers go by falling frequency.  As tables these are joins; only the
last step of a mining run, the frequent itemsets, is ever numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(found: DataFrame, *keys: str) -> DataFrame:
    """``found`` with rank from 0, most frequent first, ties by the keys."""
    return found.withColumn("rank", (F.row_number().over(W.orderBy(F.desc("freq"), *keys)) - 1).cast("int"))


def exists_pair(pairs: DataFrame, elem1: int, elem2: int) -> bool:
    return bool(pairs.where((F.col("elem1") == elem1) & (F.col("elem2") == elem2)).limit(1).count())


def rank_of(pairs: DataFrame, elem1: int, elem2: int) -> int:
    """The pair's rank, -1 if it is not there."""
    row = pairs.where((F.col("elem1") == elem1) & (F.col("elem2") == elem2)).select("rank").first()
    return -1 if row is None else row[0]


def pair_of(pairs: DataFrame, rank: int) -> tuple[int, int] | None:
    row = pairs.where(F.col("rank") == rank).select("elem1", "elem2").first()
    return None if row is None else (row[0], row[1])


def partners(pairs: DataFrame) -> DataFrame:
    """(elem1, elems2): what each first element is paired with."""
    return pairs.groupBy("elem1").agg(F.array_sort(F.collect_set("elem2")).alias("elems2"))


def extremes(pairs: DataFrame) -> DataFrame:
    """One row: the largest elements on either side, and the number of pairs."""
    return pairs.agg(F.max("elem1").alias("max1"), F.max("elem2").alias("max2"), F.count("*").alias("n"))


def split(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """Numbers of longer itemsets as (item, number of the rest): ``frequent``
    (itemset, rank) against ``shorter`` (itemset, rank)."""
    rest = shorter.select(F.col("itemset").alias("rest"), F.col("rank").alias("rest_rank"))
    return frequent.withColumn("rest", F.expr("slice(itemset, 2, size(itemset) - 1)")).join(rest, "rest").select(
        "rank", F.element_at("itemset", 1).alias("item"), "rest_rank"
    )
