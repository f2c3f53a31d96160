"""Frequent items, their ranks, and transactions as ranks.

Rank 0 is the most frequent item; ties go by the item's string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A dictionary of at most this many items goes to every executor; a larger
#: one is joined by a shuffle.  Up to INLINE items need no join at all.
BROADCAST_ITEMS, INLINE = 1_000_000, 256


def item_counts(transactions: DataFrame, min_count: int = 1) -> DataFrame:
    """(item, freq) of items in at least ``min_count`` transactions."""
    items = transactions.select(F.explode(F.array_distinct("items")).alias("item")).where(F.col("item").isNotNull())
    return items.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_count)


def dictionary(frequent: DataFrame) -> DataFrame:
    """(item, freq, rank).  One window over all frequent items: there are at
    most 1 / min-supp times the mean transaction length of them."""
    return frequent.withColumn("rank", (F.row_number().over(W.orderBy(F.desc("freq"), "item")) - 1).cast("int"))


class Encoding:
    """The dictionary of a run: small tables of items, and encoders."""

    def __init__(self, transactions: DataFrame, min_count: int, inline: int = INLINE, broadcast: int = BROADCAST_ITEMS):
        self.transactions, self.min_count, self.inline, self.broadcast = transactions, min_count, inline, broadcast
        spark = transactions.sparkSession
        frequent = item_counts(transactions, min_count)
        # At most min_count-th parts of all items' occurrences come to the driver.
        rows = sorted(frequent.collect(), key=lambda r: (-r["freq"], r["item"]))
        self.items = [r["item"] for r in rows]
        self.freqs = [r["freq"] for r in rows]
        self.table = spark.createDataFrame([(i, f, k) for k, (i, f) in enumerate(zip(self.items, self.freqs))], "item string, freq long, rank int")

    def __len__(self) -> int:
        return len(self.items)

    def encoded(self) -> DataFrame:
        """(tid, r): the ranks of each transaction's frequent items, ascending;
        may be empty.  Narrow for small dictionaries, which become part of the
        expression; else one pass by tid."""
        if len(self) <= self.inline:
            # array_intersect keeps the order of its first argument, so ranks come out ascending.
            known = F.array(*map(F.lit, self.items)).cast("array<string>")
            found = F.array_intersect(known, F.array_compact("items"))
            rank = F.transform(found, lambda x: (F.array_position(known, x) - 1).cast("int"))
            return self.transactions.select("tid", rank.alias("r"))
        pairs = self.transactions.select("tid", F.explode_outer(F.array_distinct("items")).alias("item"))
        joined = pairs.join(self.sized(self.table.select("item", "rank")), "item", "left")
        return joined.groupBy("tid").agg(F.array_sort(F.collect_list("rank")).alias("r"))

    def sized(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if len(self) <= self.broadcast else table

    def patterns(self) -> DataFrame:
        """(r, w): distinct encoded transactions and how many there are of
        each.  All counting below runs on these, not on transactions."""
        return self.encoded().where(F.size("r") > 0).groupBy("r").agg(F.count("*").alias("w"))

    def singles(self) -> DataFrame:
        """The frequent items as itemsets of one rank."""
        return self.table.select(F.array("rank").alias("itemset"), "freq")

    def decode(self, fis: DataFrame, column: str = "itemset") -> DataFrame:
        """Itemsets of ranks to ``items`` in string order."""
        if len(self) <= self.inline:
            known = F.array(*map(F.lit, self.items)).cast("array<string>")
            named = F.array_sort(F.transform(F.col(column), lambda k: F.get(known, k)))
            return fis.withColumn("items", named).drop(column)
        others = [c for c in fis.columns if c != column]
        one = fis.withColumn("_id", F.col(column)).withColumn("rank", F.explode(column)).drop(column)
        named = one.join(self.sized(self.table.select("rank", "item")), "rank")
        return named.groupBy("_id", *others).agg(F.array_sort(F.collect_list("item")).alias("items")).drop("_id")
