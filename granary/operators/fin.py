"""Mining with difference nodesets over prefix trees.

An item's nodeset is its nodes in the tree.  The difference nodeset of items
x y is the nodes of x that have no ancestor y; of an itemset with two last
items, the nodes that the second one's has and the first one's has not.  A
support is the parent's less the counts of those nodes.  An extension with its
parent's support makes the added item equivalent: it and its fellows can be
added to all itemsets below in any combination, so one row with a base and
equivalent items stands for many itemsets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import subsets
from granary.operators import ppc
from granary.storage import Scratch

CLOSED = "base array<int>, equiv array<int>, freq long"
#: Items in a group's transactions up to which one task grows its tree.
TREE_CELLS = 4_000_000
MODES = ("PAR_SPARK", "SEQ_SPARK", "SEQ_PURE_JAVA")


@dataclass
class Nodes:
    """Some nodes of the tree that belong to one extension."""

    last: int
    pre: np.ndarray
    cnt: np.ndarray
    support: int


@dataclass
class Branch:
    """An itemset, the items equivalent to it, and its frequent extensions."""

    items: tuple[int, ...]
    support: int
    equiv: tuple[int, ...]
    sons: list[Nodes]

    def row(self) -> tuple[list[int], list[int], int]:
        return list(self.items), list(self.equiv), self.support


def first_branches(nodes: pd.DataFrame, min_count: int, mine) -> Iterator[Branch]:
    """A branch for each frequent item for which ``mine`` holds, the least
    frequent items first, from a tree's rows (item, pre, post, cnt)."""
    nodes = nodes.sort_values(["item", "pre"])
    item, pre, post, cnt = (nodes[c].to_numpy(dtype=np.int64) for c in ("item", "pre", "post", "cnt"))
    names, start = np.unique(item, return_index=True)
    stop = np.append(start[1:], len(item))
    for i in range(len(names) - 1, -1, -1):
        own = slice(start[i], stop[i])
        support = int(cnt[own].sum())
        if support < min_count or not mine(int(names[i])):
            continue
        equiv, sons = [], []
        for j in range(i - 1, -1, -1):
            # Nodes of one item are never below each other, so the only possible ancestor is the last that begins before.
            up, end = pre[start[j] : stop[j]], post[start[j] : stop[j]]
            at = np.searchsorted(up, pre[own]) - 1
            lone = (at < 0) | (end[np.maximum(at, 0)] < post[own])
            left = support - int(cnt[own][lone].sum())
            if left == support:
                equiv.append(int(names[j]))
            elif left >= min_count:
                sons.append(Nodes(int(names[j]), pre[own][lone], cnt[own][lone], left))
        yield Branch((int(names[i]),), support, tuple(equiv), sons)


def below(parent: Branch, k: int, min_count: int) -> Branch:
    """The parent's k-th extension as a branch."""
    own = parent.sons[k]
    equiv, sons = list(parent.equiv), []
    for other in parent.sons[k + 1 :]:
        new = ~np.isin(other.pre, own.pre, assume_unique=True)
        left = own.support - int(other.cnt[new].sum())
        if left == own.support:
            equiv.append(other.last)
        elif left >= min_count:
            sons.append(Nodes(other.last, other.pre[new], other.cnt[new], left))
    return Branch((*parent.items, own.last), own.support, tuple(equiv), sons)


def subtree(branch: Branch, min_count: int) -> Iterator[Branch]:
    """The branch and all below it."""
    todo = [branch]
    while todo:
        now = todo.pop()
        yield now
        todo += [below(now, k, min_count) for k in range(len(now.sons))]


def frame(rows: list[tuple[list[int], list[int], int]]) -> pd.DataFrame:
    return pd.DataFrame({"base": pd.Series([r[0] for r in rows], dtype=object), "equiv": pd.Series([r[1] for r in rows], dtype=object), "freq": np.array([r[2] for r in rows], dtype=np.int64)})


def closed(encoding, mode: str = "PAR_SPARK", groups: int | None = None, seq_len: int = 1, tree_cells: int = TREE_CELLS) -> DataFrame:
    """(base, equiv, freq), each standing for the base with any of its
    equivalent items.

    PAR_SPARK grows a tree for each of ``groups`` groups of items (by default
    one for each frequent item) and mines in it the itemsets whose least
    frequent item is in the group: disjoint and complete, with nothing to merge.
    A group whose transactions have more than ``tree_cells`` items in all is cut
    first: each of its items gets the transactions before it as a database of
    its own, with a tree for each second item, and so on.
    SEQ_SPARK grows one tree, walks it in one task to itemsets of ``seq_len``
    and deals what is below to all tasks.  SEQ_PURE_JAVA does all in one task.
    """
    if mode not in MODES:
        raise ValueError(f"Bad value of '--run-type {mode}', allowed values: {' | '.join(MODES)}")
    spark, least = encoding.transactions.sparkSession, encoding.min_count
    patterns = encoding.patterns()
    if mode == "PAR_SPARK":
        n = max(1, min(groups or len(encoding), max(1, len(encoding))))
        return parallel(patterns, n, least, tree_cells)
    trees = ppc.tree(patterns.select(F.lit(0).alias("gid"), "r", "w")).select("gid", "item", "pre", "post", "cnt")

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return frame([b.row() for first in first_branches(group, least, lambda x: True) for b in subtree(first, least)])

    if mode == "SEQ_PURE_JAVA":
        return trees.groupBy("gid").applyInPandas(whole, CLOSED)

    def to_roots(group: pd.DataFrame) -> pd.DataFrame:
        """Itemsets shorter than seq_len as rows, those of it as tasks."""
        done, level = [], list(first_branches(group, least, lambda x: True))
        for _ in range(seq_len - 1):
            done += [b.row() for b in level]
            level = [below(b, k, least) for b in level for k in range(len(b.sons))]
        out = frame(done + [b.row() for b in level])
        out["task"] = pd.Series([None] * len(done) + [pickle.dumps(b) if b.sons else None for b in level], dtype=object)
        return out

    def from_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch["task"]:
                yield frame([b.row() for b in subtree(pickle.loads(task), least)][1:])

    roots = trees.groupBy("gid").applyInPandas(to_roots, CLOSED + ", task binary")
    spread = roots.where(F.col("task").isNotNull()).repartition(spark.sparkContext.defaultParallelism)
    return roots.drop("task").unionByName(spread.mapInPandas(from_roots, CLOSED))


def parallel(patterns: DataFrame, groups: int, least: int, tree_cells: int) -> DataFrame:
    """Group by group; what is too large for a task is cut by its items."""
    spark = patterns.sparkSession
    scratch, turn = Scratch(spark, "fin"), 0
    out = spark.createDataFrame([], CLOSED)
    rows = ppc.conditional(patterns, groups) if groups > 1 else patterns.select(F.lit(0).alias("gid"), "r", "w")
    rows = rows.select(F.array().cast("array<int>").alias("stem"), "gid", "r", "w")
    while True:
        turn += 1
        rows = scratch.save(rows, f"rows-{turn}")
        sizes = rows.groupBy("stem", "gid").agg(F.sum(F.size("r")).alias("cells"), F.max(F.size("r")).alias("longest"))
        large = scratch.save(sizes.where((F.col("cells") > tree_cells) & (F.col("longest") > 1)).select("stem", "gid"), f"large-{turn}")
        some = bool(large.limit(1).count())
        fit = rows.join(large, ["stem", "gid"], "left_anti") if some else rows
        out = out.unionByName(mined(fit, groups if turn == 1 else None, least))
        if not some:
            return out
        # Each item that its group mines: an itemset of its own, and the transactions before it.
        cut = rows.join(large, ["stem", "gid"], "left_semi").select("stem", "gid", "r", "w", F.posexplode("r").alias("at", "item"))
        mine = F.pmod("item", F.lit(groups)) == F.col("gid") if turn == 1 else F.col("item") == F.col("gid")
        cut = cut.where(mine).select(F.concat("stem", F.array("item")).alias("stem"), F.expr("slice(r, 1, at)").alias("r"), "w")
        found = scratch.save(cut.groupBy("stem").agg(F.sum("w").alias("freq")).where(F.col("freq") >= least), f"found-{turn}")
        out = out.unionByName(found.select(F.col("stem").alias("base"), F.array().cast("array<int>").alias("equiv"), "freq"))
        each = cut.join(found.select("stem"), "stem", "left_semi").groupBy("stem", "r").agg(F.sum("w").alias("w"))
        # A tree for each next item, of what comes up to it.
        each = each.select("stem", "w", "r", F.posexplode("r").alias("at", "gid"))
        rows = each.select("stem", "gid", F.expr("slice(r, 1, at + 1)").alias("r"), "w").groupBy("stem", "gid", "r").agg(F.sum("w").alias("w"))


def mined(rows: DataFrame, groups: int | None, least: int) -> DataFrame:
    """What the groups (stem, gid) hold: itemsets of the stem and items whose
    least frequent one is the group's."""
    trees = ppc.tree(rows, "stem", "gid").select("stem", "gid", "item", "pre", "post", "cnt")

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        gid, stem = int(group["gid"].iloc[0]), tuple(int(x) for x in group["stem"].iloc[0])
        firsts = first_branches(group, least, lambda x: x % groups == gid if groups else x == gid)
        return frame([(list(stem) + base, equiv, freq) for first in firsts for base, equiv, freq in (b.row() for b in subtree(first, least))])

    return trees.groupBy("stem", "gid").applyInPandas(whole, CLOSED)


def fin(encoding, mode: str = "PAR_SPARK", groups: int | None = None, seq_len: int = 1, tree_cells: int = TREE_CELLS) -> DataFrame:
    """(itemset, freq) of all frequent itemsets."""
    return subsets.expand(closed(encoding, mode, groups, seq_len, tree_cells))


def fin_count(encoding, mode: str = "PAR_SPARK", groups: int | None = None, seq_len: int = 1) -> int:
    """How many there are, without making them."""
    return closed(encoding, mode, groups, seq_len).agg(subsets.expanded_count()).first()[0]
