"""Connected components as DataFrames: large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each end of ``edges`` (columns a, b): the root is the
    least node of its component.  Each round is written to shared storage;
    a component of diameter d takes about log d rounds."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges-0")
    turn = 0
    while True:
        turn += 1
        # Large star: each node's greater neighbours move to its least neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("rebalance"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a node and its lesser neighbours all move to the least.
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lows.hint("rebalance"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new = scratch.save(small, f"edges-{turn}")
        # Done when no edge changed: same count and no edge of the new set was absent before.
        if not new.join(now, ["a", "b"], "left_anti").limit(1).count() and new.count() == now.count():
            break
        scratch.drop(f"edges-{turn - 1}")
        now = new
    roots = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
