"""Prefix trees with pre- and post-order numbers, as tables.

A node is a distinct prefix of rank-sorted transactions, so a tree is a count
by prefix; arrays sort a prefix before its extensions, so a node's place in
that order is its pre-order number.  With a number above all ranks at its end a
prefix sorts after its extensions, which gives the post-order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conditional(patterns: DataFrame, groups: int) -> DataFrame:
    """(gid, r, w): for each group of items (rank modulo ``groups``) the part
    of each transaction up to its last item of that group."""
    rows = patterns.select("r", "w", F.posexplode("r").alias("at", "rank"))
    last = rows.groupBy("r", "w", F.pmod("rank", F.lit(groups)).alias("gid")).agg(F.max("at").alias("at"))
    return last.select("gid", F.expr("slice(r, 1, at + 1)").alias("r"), "w").groupBy("gid", "r").agg(F.sum("w").alias("w"))


def tree(rows: DataFrame, *by: str) -> DataFrame:
    """(gid, prefix, item, cnt, pre, post) from (gid, r, w), without the root,
    which has pre-order number 1.  Numbers are within a group's tree; groups may
    be named ``by`` other columns."""
    by = by or ("gid",)
    prefixes = F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: F.slice("r", F.lit(1), i))
    nodes = rows.where(F.size("r") > 0).select(*by, F.explode(prefixes).alias("prefix"), "w").groupBy(*by, "prefix").agg(F.sum("w").alias("cnt"))
    own = W.partitionBy(*by)
    return nodes.select(
        *by,
        "prefix",
        F.element_at("prefix", -1).alias("item"),
        "cnt",
        (1 + F.row_number().over(own.orderBy("prefix"))).cast("long").alias("pre"),
        F.row_number().over(own.orderBy(F.array_append("prefix", F.lit((1 << 31) - 1)))).cast("long").alias("post"),
    )


def root(nodes: DataFrame) -> DataFrame:
    """Each group's root: (gid, prefix, item, cnt, pre, post)."""
    return nodes.groupBy("gid").agg(F.count("*").alias("n")).select(
        "gid", F.array().cast("array<int>").alias("prefix"), F.lit(None).cast("int").alias("item"), F.lit(0).cast("long").alias("cnt"), F.lit(1).cast("long").alias("pre"), (F.col("n") + 1).alias("post")
    )


def merge(*trees: DataFrame) -> DataFrame:
    """(gid, prefix, cnt): counts of several trees together."""
    out = trees[0].select("gid", "prefix", "cnt")
    for other in trees[1:]:
        out = out.unionByName(other.select("gid", "prefix", "cnt"))
    return out.groupBy("gid", "prefix").agg(F.sum("cnt").alias("cnt"))


def node_at(nodes: DataFrame, *path: int) -> DataFrame:
    return nodes.where(F.col("prefix") == F.array(*map(F.lit, path)).cast("array<int>"))


def item_nodes(nodes: DataFrame) -> DataFrame:
    """(gid, item, nodes, freq): an item's nodes in pre-order."""
    return nodes.groupBy("gid", "item").agg(
        F.array_sort(F.collect_list(F.struct("pre", "post", "cnt"))).alias("nodes"), F.sum("cnt").alias("freq")
    )


def pair_supports(nodes: DataFrame, singles: DataFrame, groups: int) -> DataFrame:
    """(x, y, freq): supports of pairs with y more frequent, from the nodes of
    x that have an ancestor y, in the tree of x's group (x's support less that
    of its nodes without one)."""
    own = nodes.where(F.pmod("item", F.lit(groups)) == F.col("gid"))
    above = own.select(F.col("item").alias("x"), F.explode(F.expr("slice(prefix, 1, size(prefix) - 1)")).alias("y"), "cnt")
    found = above.groupBy("x", "y").agg(F.sum("cnt").alias("freq"))
    # Pairs that never meet: each item with all that are more frequent, which is the result's size.
    x = F.col("itemset")[0]
    every = singles.where(x > 0).select(x.alias("x"), F.explode(F.sequence(F.lit(0), x - 1)).alias("y"))
    return every.join(found, ["x", "y"], "left").select("x", "y", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))
