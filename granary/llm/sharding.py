"""Uniform shuffle into shards of exact size by a communication matrix.

Rows fall into logical blocks by a hash of their content.  Only the blocks'
row counts come to the driver, which draws how many rows of each block go to
each shard from the multivariate hypergeometric law: exactly the counts that a
uniform random permutation cut into shards would have.  Each block is permuted
locally (rank by a keyed hash) and cut at the drawn counts; after the exchange
each shard is permuted again to give gapless slots.  Shard sizes differ by at
most one row.  No text is shuffled: sizes and checksums are taken at the scan.

The second permutation ranks within strips of a shard and adds the strips'
offsets, so no task holds a whole shard.

Defined results: a null text has size 1 and checksum 0; rows with equal
doc_id, size and checksum are interchangeable, and each gets its own slot;
null doc_ids are ordinary values; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a block or strip holds on average, and the most blocks there are:
#: the driver holds at most MOST_BLOCKS x shards counts.
BLOCK_ROWS, MOST_BLOCKS = 20_000, 8192


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each block for each shard; margins are exact."""
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.Generator(np.random.Philox(seed))
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        n, rest = int(n), sum(left)
        for s in range(shards):
            out[i, s] = hypergeometric(rng, left[s], rest, n)
            n, rest = n - int(out[i, s]), rest - left[s]
            left[s] -= int(out[i, s])
    return out


def hypergeometric(rng: np.random.Generator, good: int, total: int, n: int) -> int:
    """How many of ``n`` items drawn from ``total`` are among the ``good``.

    By inversion over the support around the mode: neighbouring weights have a
    simple ratio, so no factorials are needed and populations have no limit.
    """
    low, high = max(0, n - (total - good)), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    reach = 60 + int(14 * (n * good / total * max(total - good, 1) / total) ** 0.5)
    low, high = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - x) * (n - x)) - np.log((x + 1) * (total - good - n + x + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(logs - logs.max())
    return low + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right").clip(0, high - low))


def shuffle_rows(docs: DataFrame, shards: int = 8, seed: int = 20_240_607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # The count of rows comes from Parquet footers where the input is Parquet.
    blocks = max(1, min(MOST_BLOCKS, -(-docs.count() // BLOCK_ROWS)))
    content = ("doc_id", "size", "text_crc32")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(blocks)).cast("int"))
    # The same hash of the same columns: counting reads texts again, but shuffles only counts.
    counts = {r[0]: r[1] for r in rows.groupBy("_block").count().collect()}
    drawn = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    ends = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(drawn[b])]) for b in range(blocks)], "_block int, _ends array<long>"
    )
    local = W.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), *content), *content)
    strips = max(1, blocks // shards)
    dealt = (
        rows.withColumn("_rank", F.row_number().over(local))
        .join(F.broadcast(ends), "_block")  # at most MOST_BLOCKS rows of `shards` numbers
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .drop("_ends", "_rank", "_block")
        .withColumn("_key", F.xxhash64(F.lit(seed + 2), *content))
        .withColumn("_strip", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(strips)).cast("int"))
    )
    within = W.partitionBy("shard", "_strip").orderBy("_key", *content)
    ranked = dealt.withColumn("_at", F.row_number().over(within))
    sizes = dealt.groupBy("shard", "_strip").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_strip").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ranked.join(F.broadcast(offsets), ["shard", "_strip"]).select(  # at most MOST_BLOCKS rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
