"""Vertical layout: which transactions hold an itemset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(encoded: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """(itemset, tid) for frequent itemsets of a size, from (tid, r)."""
    rows = encoded.select("tid", F.array().cast("array<int>").alias("itemset"), F.col("r").alias("tail"))
    for _ in range(size):
        rows = rows.select("tid", "itemset", "tail", F.posexplode("tail").alias("at", "rank")).select(
            "tid", F.concat("itemset", F.array("rank")).alias("itemset"), F.expr("slice(tail, at + 2, size(tail))").alias("tail")
        )
    return rows.join(frequent.select("itemset"), "itemset", "left_semi").select("itemset", "tid")


def tid_lists(rows: DataFrame) -> DataFrame:
    """(itemset, tids) for small data: an itemset's transactions are one row."""
    return rows.groupBy("itemset").agg(F.array_sort(F.collect_list("tid")).alias("tids"))


def tid_bitmaps(rows: DataFrame) -> DataFrame:
    """(itemset, bucket, bits): bitmaps of transaction numbers in buckets of
    32768, so no row grows with the number of transactions."""
    return rows.groupBy("itemset", F.bitmap_bucket_number("tid").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("tid")).alias("bits")
    )


def merge_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One bitmap for each itemset and bucket out of several."""
    return bitmaps.groupBy("itemset", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_support(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("itemset").agg(F.sum(F.bitmap_count("bits")).alias("freq"))


def describe(rows: DataFrame) -> DataFrame:
    """(itemset, size, min, max) of the transactions that hold it."""
    return rows.groupBy("itemset").agg(F.count("*").alias("size"), F.min("tid").alias("min"), F.max("tid").alias("max"))


def partition_extremes(rows: DataFrame) -> DataFrame:
    """(part, min, max): the transactions in each partition."""
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min("tid").alias("min"), F.max("tid").alias("max"))


def stored(lists: DataFrame, total: int) -> DataFrame:
    """(itemset, complement, tids): the transactions that hold an itemset or,
    where those are more than half of ``total``, the ones that don't.  From
    (itemset, tids) with numbers from 0 on; for small data, as ``tid_lists``."""
    many = 2 * F.size("tids") > total
    return lists.select("itemset", many.alias("complement"), F.when(many, _others(total)).otherwise(F.col("tids")).alias("tids"))


def restored(sets: DataFrame, total: int) -> DataFrame:
    """(itemset, tids) from what ``stored`` gives."""
    return sets.select("itemset", F.when(F.col("complement"), _others(total)).otherwise(F.col("tids")).alias("tids"))


def _others(total: int) -> Column:
    every = F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long")) if total else F.array().cast("array<bigint>")
    return F.array_except(every, F.col("tids"))


def prefix_classes(frequent: DataFrame) -> DataFrame:
    """(prefix, members, freqs): itemsets of one size that share all but the
    last item."""
    return (
        frequent.groupBy(F.expr("slice(itemset, 1, size(itemset) - 1)").alias("prefix"))
        .agg(F.array_sort(F.collect_list(F.struct(F.element_at("itemset", -1).alias("rank"), "freq"))).alias("m"))
        .select("prefix", F.col("m.rank").alias("members"), F.col("m.freq").alias("freqs"))
    )


def partitions_for(prefixes: int, processors: int, most: int | None = None) -> tuple[int, str]:
    """Tasks for the classes, and how the number came about."""
    said = [f"prefixes={prefixes}", f"processors={processors}"]
    n = min(prefixes, processors)
    if most is not None:
        n = min(n, most)
        said.append(f"user-prop={most}")
    return max(1, n), f"{n} = min({', '.join(said)})"
