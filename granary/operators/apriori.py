"""Level-wise mining as joins and aggregations.

A level's occurrences are rows (itemset, tail, w): an itemset, the ranks that
follow it in some transactions, and how many transactions those are.  The next
level explodes the tails, so no join by transaction is needed, equal rows
merge before they are counted, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.encode import BROADCAST_ITEMS
from granary.storage import Scratch


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where the size allows."""
    return F.broadcast(small) if rows <= BROADCAST_ITEMS else small


def first_occurrences(patterns: DataFrame) -> DataFrame:
    """Occurrences of single items, from (r, w)."""
    rows = patterns.select("r", "w", F.posexplode("r").alias("at", "rank"))
    return merged(rows.select(F.array("rank").alias("itemset"), F.expr("slice(r, at + 2, size(r))").alias("tail"), "w"))


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("itemset", "tail").agg(F.sum("w").alias("w"))


def extensions(occurrences: DataFrame) -> DataFrame:
    """Occurrences of itemsets with one more item, candidates or not."""
    rows = occurrences.select("itemset", "tail", "w", F.posexplode("tail").alias("at", "rank"))
    return rows.select(F.concat("itemset", F.array("rank")).alias("itemset"), F.expr("slice(tail, at + 2, size(tail))").alias("tail"), "w")


def pair_counts(patterns: DataFrame, min_count: int = 1) -> DataFrame:
    """(r1, r2, freq) of pairs of items."""
    rows = patterns.select("r", "w", F.posexplode("r").alias("at", "r1"))
    pairs = rows.select("r1", F.explode(F.expr("slice(r, at + 2, size(r))")).alias("r2"), "w")
    return pairs.groupBy("r1", "r2").agg(F.sum("w").alias("freq")).where(F.col("freq") >= min_count)


def candidates(frequent: DataFrame) -> DataFrame:
    """(itemset) of one more item all of whose subsets of one less are
    frequent, from frequent itemsets of one size: two that differ in the last
    item join, then every other subset must be frequent as well."""
    stem = F.expr("slice(itemset, 1, size(itemset) - 1)")
    left = frequent.select(stem.alias("stem"), "itemset", F.element_at("itemset", -1).alias("a"))
    right = frequent.select(stem.alias("stem"), F.element_at("itemset", -1).alias("b"))
    joined = left.join(right, "stem").where("a < b").select(F.concat("itemset", F.array("b")).alias("candidate"))
    checks = joined.select("candidate", F.explode(F.expr("sequence(1, size(candidate))")).alias("out")).select(
        "candidate", F.expr("filter(candidate, (x, i) -> i != out - 1)").alias("itemset")
    )
    found = checks.join(frequent.select("itemset"), "itemset", "left_semi").groupBy("candidate").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == F.size("candidate")).select(F.col("candidate").alias("itemset"))


def count_candidates(occurrences: DataFrame, wanted: DataFrame, rows: int, min_count: int) -> DataFrame:
    """(itemset, freq) of candidates that are frequent."""
    found = extensions(occurrences).select("itemset", "w").join(bounded(wanted, rows), "itemset", "left_semi")
    return found.groupBy("itemset").agg(F.sum("w").alias("freq")).where(F.col("freq") >= min_count)


class Levels:
    """The state of a level-wise run: the levels so far, and occurrences of
    the last one, each written to shared storage."""

    def __init__(self, encoding, scratch: Scratch):
        self.encoding, self.scratch, self.min_count = encoding, scratch, encoding.min_count
        self.levels: list[DataFrame] = [encoding.singles()]
        self.sizes: list[int] = [len(encoding)]
        self.occurrences = scratch.save(first_occurrences(encoding.patterns()), "occurrences-1")

    @property
    def size(self) -> int:
        return len(self.levels)

    def step(self) -> int:
        """Add the next level; the number of its itemsets."""
        k = self.size + 1
        wanted = self.scratch.save(candidates(self.levels[-1]), f"candidates-{k}")
        n = wanted.count()
        found = self.scratch.save(count_candidates(self.occurrences, wanted, n, self.min_count), f"level-{k}")
        self.levels.append(found)
        self.sizes.append(found.count())
        return self.sizes[-1]

    def advance(self) -> None:
        """Make the occurrences those of the last level."""
        k = self.size
        last = bounded(self.levels[-1].select("itemset"), self.sizes[-1])
        rows = merged(extensions(self.occurrences).join(last, "itemset", "left_semi"))
        self.occurrences = self.scratch.save(rows, f"occurrences-{k}")
        self.scratch.drop(f"occurrences-{k - 1}")

    def found(self) -> DataFrame:
        out = self.levels[0]
        for level in self.levels[1:]:
            out = out.unionByName(level)
        return out


def apriori(encoding, max_size: int | None = None) -> DataFrame:
    """(itemset, freq) of all frequent itemsets."""
    levels = Levels(encoding, Scratch(encoding.transactions.sparkSession, "apriori"))
    while levels.sizes[-1] > 1 and (max_size is None or levels.size < max_size):
        if levels.size > 1:
            levels.advance()
        if not levels.step():
            break
    return levels.found()
