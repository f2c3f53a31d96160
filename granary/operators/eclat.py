"""Depth-first mining of equivalence classes over vertical sets.

A class is the itemsets that share a prefix.  Its rows are the distinct tails
behind the prefix, each with the number of its transactions; a member's set is
a row of bits over them, 64 to a word, and its support the weights' sum: the
weights are kept as bits too, so a sum is a few population counts.  So a class
is as large as its distinct tails, not its transactions, and one that is still
too large for a task, in rows or in bits, is extended by one level first, which
cuts it in smaller ones.  The walk holds one class for each level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators import apriori
from granary.storage import Scratch

#: Rows of a class that one task mines, and bits of its members' sets.
CLASS_ROWS, CLASS_BITS = 500_000, 1 << 30
#: A class of at least so many members drops empty columns if that leaves at
#: most this share of them.
SQUEEZE_MEMBERS, SQUEEZE_SHARE = 4, 0.8

SCHEMA = "itemset array<int>, freq long"


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words."""
    raw = np.packbits(rows, axis=-1, bitorder="little")
    out = np.zeros((*raw.shape[:-1], -(-raw.shape[-1] // 8) * 8), dtype=np.uint8)
    out[..., : raw.shape[-1]] = raw
    return out.view(np.uint64)


def unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, count=n, bitorder="little").astype(bool)


def weight_bits(weights: np.ndarray) -> list[np.ndarray]:
    """For each binary digit, the rows whose weight has it."""
    return [packed((weights >> k & 1).astype(bool)) for k in range(max(1, int(weights.max(initial=0)).bit_length()))]


def supports_of(sets: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    return sum((np.bitwise_count(sets & d).sum(axis=-1, dtype=np.int64) << k for k, d in enumerate(digits)), np.zeros(len(sets), dtype=np.int64))


@dataclass
class Class:
    """Members behind a prefix with their sets (what they lack against the
    prefix if ``lacks``), and the next member to extend."""

    prefix: tuple[int, ...]
    members: np.ndarray
    sets: np.ndarray
    supports: np.ndarray
    weights: np.ndarray
    digits: list[np.ndarray]
    lacks: bool = False
    at: int = 0

    def squeezed(self) -> "Class":
        n = len(self.weights)
        used = unpacked(np.bitwise_or.reduce(self.sets, axis=0), n)
        if used.sum() > SQUEEZE_SHARE * n:
            return self
        sets = np.stack([packed(unpacked(s, n)[used]) for s in self.sets])
        return Class(self.prefix, self.members, sets, self.supports, self.weights[used], weight_bits(self.weights[used]), self.lacks)


def mine_class(prefix: tuple[int, ...], members: np.ndarray, sets: np.ndarray, supports: np.ndarray, weights: np.ndarray, min_count: int, diffsets: bool, squeeze: bool) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent itemsets longer than prefix + one member, from the members'
    sets as words; with ``diffsets`` deeper levels keep what an extension loses
    instead of what it has."""

    def entered(c: Class) -> Class:
        return c.squeezed() if squeeze and len(c.members) >= SQUEEZE_MEMBERS else c

    path = [entered(Class(prefix, members, sets, supports, weights, weight_bits(weights)))]
    while path:
        now = path[-1]
        i = now.at
        if i >= len(now.members) - 1:
            path.pop()
            continue
        now.at += 1
        own, others = now.sets[i], now.sets[i + 1 :]
        if now.lacks:
            new = others & ~own
            supp = now.supports[i] - supports_of(new, now.digits)
        elif diffsets:
            new = own & ~others
            supp = now.supports[i] - supports_of(new, now.digits)
        else:
            new = others & own
            supp = supports_of(new, now.digits)
        keep = np.flatnonzero(supp >= min_count)
        if not len(keep):
            continue
        stem = (*now.prefix, int(now.members[i]))
        names, found = now.members[i + 1 :][keep], supp[keep]
        for name, n in zip(names.tolist(), found.tolist()):
            yield (*stem, name), n
        if len(keep) > 1:
            path.append(entered(Class(stem, names, new[keep], found, now.weights, now.digits, diffsets)))


def classes(occurrences: DataFrame) -> DataFrame:
    """(itemset, n, bits): sizes of the classes whose prefix is an itemset; a
    class has no more members than ranks in its range, or ranks in its tails."""
    ranks = F.max(F.element_at("tail", -1)) - F.min(F.element_at("tail", 1)) + 1
    rows = occurrences.where(F.size("tail") > 0).groupBy("itemset").agg(F.count("*").alias("n"), F.least(ranks, F.sum(F.size("tail"))).alias("members"))
    return rows.select("itemset", "n", (F.col("n") * F.col("members")).alias("bits"))


def class_stats(occurrences: DataFrame) -> DataFrame:
    """(itemset, n_tails, n_transactions, longest): what mining the class of
    each prefix would start from."""
    rows = occurrences.where(F.size("tail") > 0)
    return rows.groupBy("itemset").agg(F.count("*").alias("n_tails"), F.sum("w").alias("n_transactions"), F.max(F.size("tail")).alias("longest"))


def eclat(occurrences: DataFrame, min_count: int, diffsets: bool = True, squeeze: bool = False, parts: int | None = None, scratch: Scratch | None = None, class_rows: int = CLASS_ROWS, class_bits: int = CLASS_BITS) -> DataFrame:
    """(itemset, freq) of all frequent itemsets longer than those in
    ``occurrences`` (itemset, tail, w)."""
    spark = occurrences.sparkSession
    scratch = scratch or Scratch(spark, "eclat")
    out = spark.createDataFrame([], SCHEMA)
    rows, turn = occurrences.where(F.size("tail") > 0), 0
    while True:
        # Classes that are too large: their extensions are counted here and become classes themselves.
        large = classes(rows).where((F.col("n") > class_rows) | (F.col("bits") > class_bits)).select("itemset")
        n_large = large.count()
        fit = rows if not n_large else rows.join(apriori.bounded(large, n_large), "itemset", "left_anti")
        out = out.unionByName(mined(fit, min_count, diffsets, squeeze, parts))
        if not n_large:
            return out
        turn += 1
        longer = apriori.extensions(rows.join(apriori.bounded(large, n_large), "itemset", "left_semi"))
        found = scratch.save(longer.groupBy("itemset").agg(F.sum("w").alias("freq")).where(F.col("freq") >= min_count), f"split-{turn}")
        out = out.unionByName(found)
        kept = longer.join(apriori.bounded(found.select("itemset"), found.count()), "itemset", "left_semi")
        rows = scratch.save(apriori.merged(kept), f"rows-{turn}").where(F.size("tail") > 0)


def mined(rows: DataFrame, min_count: int, diffsets: bool, squeeze: bool, parts: int | None) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        prefix = tuple(int(x) for x in group["itemset"].iloc[0])
        weights = group["w"].to_numpy(dtype=np.int64)
        tails = group["tail"].tolist()
        sizes = np.array([len(t) for t in tails])
        flat = np.concatenate(tails).astype(np.int64)
        row = np.repeat(np.arange(len(tails)), sizes)
        names, code = np.unique(flat, return_inverse=True)
        supports = np.bincount(code, weights=weights[row], minlength=len(names)).astype(np.int64)
        keep = np.flatnonzero(supports >= min_count)
        order = np.argsort(code, kind="stable")
        row, ends = row[order], np.cumsum(np.bincount(code, minlength=len(names)))
        sets = np.zeros((len(keep), -(-len(tails) // 64)), dtype=np.uint64)
        for i, k in enumerate(keep.tolist()):
            has = np.zeros(len(tails), dtype=bool)
            has[row[ends[k - 1] if k else 0 : ends[k]]] = True
            sets[i] = packed(has)
        found = [((*prefix, int(names[k])), int(supports[k])) for k in keep]
        found += mine_class(prefix, names[keep], sets, supports[keep], weights, min_count, diffsets, squeeze)
        return pd.DataFrame({"itemset": pd.Series([list(i) for i, _ in found], dtype=object), "freq": np.array([n for _, n in found], dtype=np.int64)})

    dealt = rows.repartition(parts, "itemset") if parts else rows
    return dealt.groupBy("itemset").applyInPandas(run, SCHEMA)
