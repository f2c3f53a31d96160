"""Level-wise mining for short itemsets, then depth-first mining by prefix."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import apriori, eclat, vertical
from granary.storage import Scratch


@dataclass(frozen=True)
class BigFimParams:
    prefix_len: int = 3
    ratio: float = 1.1
    diffsets: bool = True
    squeeze: bool = False
    parts: int | None = None


@dataclass
class BigFimResult:
    """Itemsets of both phases, which have different lengths."""

    levels: list[DataFrame]
    deep: DataFrame | None
    note: str = ""
    sizes: list[int] = field(default_factory=list)

    def short(self) -> DataFrame:
        out = self.levels[0]
        for level in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def all(self) -> DataFrame:
        """(itemset, freq, phase)."""
        out = self.short().withColumn("phase", F.lit("apriori"))
        return out if self.deep is None else out.unionByName(self.deep.withColumn("phase", F.lit("eclat")))

    def of_length(self, n: int) -> DataFrame:
        return self.levels[n - 1]

    def deep_top(self, most: int | None = None, sort: bool = True) -> DataFrame:
        """Itemsets of the second phase, the most frequent first if asked."""
        out = self.deep if self.deep is not None else self.levels[0].limit(0)
        if sort:
            out = out.orderBy(F.desc("freq"), "itemset")
        return out if most is None else out.limit(most)

    def counts(self) -> tuple[int, int]:
        return sum(self.sizes), self.deep.count() if self.deep is not None else 0


def keeps_on(sizes: list[int], params: BigFimParams) -> bool:
    """Whether another level follows, by the sizes of the levels so far (two
    at least): yes while prefixes are short; then, unless they should be of one
    item, as long as the last level is no larger than ``ratio`` times the one
    before."""
    if sizes[-1] <= 1:
        return False
    prefix = len(sizes) - 1
    if prefix < params.prefix_len:
        return True
    if params.prefix_len <= 1:
        return False
    return sizes[-1] / sizes[-2] <= params.ratio


def mine(encoding, params: BigFimParams = BigFimParams()) -> BigFimResult:
    spark = encoding.transactions.sparkSession
    scratch = Scratch(spark, "bigfim")
    levels = apriori.Levels(encoding, scratch)
    result = BigFimResult(levels.levels, None, sizes=levels.sizes)
    if levels.sizes[0] <= 1 or not levels.step():
        return result
    while keeps_on(levels.sizes, params):
        levels.advance()
        if not levels.step():
            return result
    if levels.sizes[-1] > 1:
        # Longer itemsets are extensions of the last level's: one class for each prefix of one item less.
        prefixes = vertical.prefix_classes(levels.levels[-1]).count()
        n, result.note = vertical.partitions_for(prefixes, spark.sparkContext.defaultParallelism, params.parts)
        found = eclat.eclat(levels.occurrences, encoding.min_count, params.diffsets, params.squeeze, n, scratch)
        size = levels.size
        result.deep = scratch.save(found.where(F.size("itemset") > size), "deep")
    return result
