"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are lifted to equal norm, which turns the largest inner product into
the least distance.  Each of TABLES tables hashes a vector to a bucket by
HASHES Gaussian projections cut into cells.  A query visits the buckets around
its own in the order of their estimated chance to hold a neighbour, until the
chances add up to MASS; members of visited buckets are ranked by the exact
inner product on the original vectors, and the tables' results merge.

Equal vectors are one index entry with their smallest vec_ids, as many as a
result can show.  Index entries go to tasks by bucket; a bucket beyond BLOCK
entries is dealt over several, and queries follow to each, so no task holds
more than a few blocks.  Queries that share a vector are searched once.

Defined results: rows with a null vec_id, a vector that is null, zero or has
null or non-finite components, or whose length is not the table's commonest
take no part; ties go to the smaller vec_id; rows repeating vec_id and vector
count once; a query's candidates exclude its own vec_id; a query whose buckets
hold fewer than k candidates is searched against all entries, in blocks; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.shared import Scratch

TABLES, HASHES, MASS, SEED = 2, 6, 0.7, 77
#: Width of a cell and the distance at which neighbours are expected, in units
#: of the largest norm.
WIDTH, EXPECTED = 2.0, 1.25
#: Relative difference that rounding may make in an inner product.
ROUNDING = 1e-12
#: Index entries that a task holds on average; tasks for a small index.
BLOCK, LEAST_TASKS = 20_000, 16


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Tables:
    def __init__(self, dim: int, norm: float):
        rng = np.random.default_rng(SEED)
        self.norm = norm
        self.planes = rng.normal(size=(TABLES, HASHES, dim + 1))
        self.shift = rng.uniform(0, WIDTH, (TABLES, HASHES))
        self.near = np.array(list(itertools.product((-1, 0, 1), repeat=HASHES)))

    def cells(self, lifted: np.ndarray) -> np.ndarray:
        return np.einsum("nd,thd->nth", lifted, self.planes) / (WIDTH * self.norm) + self.shift / WIDTH

    def codes(self, table: int, cells: np.ndarray) -> np.ndarray:
        code = np.full(cells.shape[:-1], table, dtype=np.uint64)
        for h in range(HASHES):
            code = code * np.uint64(0x9E37_79B9_7F4A_7C15) + cells[..., h].astype(np.int64).view(np.uint64)
            code ^= code >> np.uint64(29)
        return code.view(np.int64)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """A bucket in each table for each vector."""
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        cells = np.floor(self.cells(np.column_stack([vectors, rest])))
        return np.stack([self.codes(t, cells[:, t]) for t in range(TABLES)], axis=1)

    def probes(self, queries: np.ndarray) -> list[np.ndarray]:
        """The buckets that each query visits, in order, table by table."""
        scaled = queries * (self.norm / np.sqrt((queries**2).sum(axis=1)))[:, None]
        at = self.cells(np.column_stack([scaled, np.zeros(len(queries))]))
        home = np.floor(at)
        cdf = np.vectorize(lambda z: 0.5 * (1 + erf(z / 2**0.5)), otypes=[float])
        chance = np.stack([cdf((k + 1 - (at - home)) * WIDTH / EXPECTED) - cdf((k - (at - home)) * WIDTH / EXPECTED) for k in (-1, 0, 1)], axis=-1)
        out: list[list[np.ndarray]] = [[] for _ in queries]
        for t in range(TABLES):
            score = np.ones((len(queries), len(self.near)))
            for h in range(HASHES):
                score *= chance[:, t, h][:, self.near[:, h] + 1]
            order = np.argsort(-score, axis=1, kind="stable")
            sums = np.cumsum(np.take_along_axis(score, order, axis=1), axis=1)
            visits = (sums < np.minimum(MASS, sums[:, -1:] * (1 - 1e-12))).sum(axis=1) + 1
            for q in range(len(queries)):
                out[q].append(self.codes(t, home[q, t] + self.near[order[q, : visits[q]]]))
        return [np.concatenate(x) for x in out]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(rows) if rows else np.zeros(0, np.int64))


class Entries:
    """Index entries: a vector, its name and the vec_ids that have it."""

    def __init__(self, names: np.ndarray, ids: list[list[int]], points: np.ndarray):
        self.names, self.points = names, points
        self.sizes = np.array([len(i) for i in ids], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([i for own in ids for i in own], dtype=np.int64)
        self.norm = np.sqrt((points**2).sum(axis=1).max(initial=0))


def best(held: Entries, spans: dict[int, tuple[int, int]], queries: list[tuple[np.ndarray, list[int]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score): the k best vec_ids for each query among
    the entries of its buckets, ties to the smaller vec_id."""
    asked: dict[int, list[int]] = {}
    for q, (_, buckets) in enumerate(queries):
        for b in buckets:
            if b in spans:
                asked.setdefault(b, []).append(q)
    points = np.stack([v for v, _ in queries])
    slack = ROUNDING * np.sqrt((points**2).sum(axis=1)) * held.norm
    who, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b, qs in asked.items():
        lo, hi = spans[b]
        s = points[qs] @ held.points[lo:hi].T
        # All that reach the k-th score, or miss it by no more than rounding.
        floor = np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k] - slack[qs] if hi - lo > k else np.full(len(qs), -np.inf)
        q, r = np.nonzero(s >= floor[:, None])
        who.append(np.array(qs)[q])
        row.append(r + lo)
    who, row = np.concatenate(who), np.concatenate(row)
    # Several tables may have found an entry.
    order = np.lexsort((held.names[row], who))
    who, row = who[order], row[order]
    new = np.append(True, (who[1:] != who[:-1]) | (held.names[row][1:] != held.names[row][:-1]))[: len(who)]
    who, row = who[new], row[new]
    score = (held.points[row] * points[who]).sum(axis=1)
    order = np.lexsort((-score, who))
    who, row, score = who[order], row[order], score[order]
    begin = np.searchsorted(who, who)
    last = np.minimum(begin + k, np.searchsorted(who, who, side="right")) - 1
    reach = score >= score[last]
    who, row, score = who[reach], row[reach], score[reach]
    # From entries to vec_ids; one that has several vectors keeps its best score.
    many = held.sizes[row]
    at = np.repeat(held.first[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
    who, score, ids = np.repeat(who, many), np.repeat(score, many), held.ids[at]
    order = np.lexsort((-score, ids, who))
    who, score, ids = who[order], score[order], ids[order]
    new = np.append(True, (who[1:] != who[:-1]) | (ids[1:] != ids[:-1]))[: len(who)]
    who, score, ids = who[new], score[new], ids[new]
    order = np.lexsort((ids, -score, who))
    who, score, ids = who[order], score[order], ids[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[kept], ids[kept], score[kept]


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose
    vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    out_schema = "k1 long, k2 long, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("embedding") == dim)
    same = W.partitionBy("embedding").orderBy("vec_id")
    entries = (
        rows.dropDuplicates(["embedding", "vec_id"])
        .withColumn("_n", F.row_number().over(same))
        .where(F.col("_n") <= k + 1)
        .groupBy("embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    entries = scratch.save(entries, "entries")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, n_ids, norm = entries.agg(F.count("*"), F.sum(F.size("ids")), F.max(F.sqrt(square))).first()
    hashing = spark.sparkContext.broadcast(Tables(dim, norm))

    def to_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = hashing.value.buckets(matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(list(own))], names=["embedding", "ids", "buckets"])

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                own = hashing.value.probes(matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists(own)], names=["k1", "k2", "embedding", "buckets"])

    kind = entries.schema["embedding"].dataType.simpleString()
    # By the index's size only: with more tasks each query would bring back more lists of k.
    tasks = max(LEAST_TASKS, -(-total * TABLES // BLOCK))
    index = entries.select("embedding", "ids").mapInArrow(to_buckets, f"embedding {kind}, ids array<long>, buckets array<long>")
    index = index.select("embedding", "ids", F.xxhash64("embedding").alias("name"), F.explode("buckets").alias("bucket"))
    hot = index.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    hot = scratch.save(hot, "hot")
    slot = F.pmod(F.xxhash64("bucket", "part"), F.lit(tasks)).cast("int").alias("slot")
    dealt = (
        index.join(hot, "bucket", "left")
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("embedding"), F.col("parts")), F.lit(0)).cast("int"))
        .select(slot, "bucket", "name", "ids", "embedding")
    )
    keys = (F.xxhash64("embedding").alias("k1"), F.xxhash64("embedding", F.lit(SEED)).alias("k2"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", *keys)
    asked = queries.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    visits = (
        asked.mapInArrow(to_probes, f"k1 long, k2 long, embedding {kind}, buckets array<long>")
        .select("k1", "k2", "embedding", F.explode("buckets").alias("bucket"))
        .join(hot, "bucket", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .groupBy(slot, "k1", "k2")
        .agg(F.first("embedding").alias("embedding"), F.collect_list("bucket").alias("buckets"))  # at most a query's probes
    )

    def rank_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition: index entries come first, then queries."""
        buckets, names, ids, points = [], [], [], []
        ready: tuple | None = None
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            n = int((flags == 0).sum())
            if n:
                part = batch.slice(0, n)
                buckets.append(part.column(2).to_numpy(zero_copy_only=False))
                names.append(part.column(8).to_numpy(zero_copy_only=False))
                ids += part.column(3).to_pylist()
                points.append(matrix(part.column(4)))
            if n < batch.num_rows and buckets:
                if ready is None:
                    code = np.concatenate(buckets).astype(np.int64)
                    order = np.argsort(code, kind="stable")
                    code = code[order]
                    own, first = np.unique(code, return_index=True)
                    held = Entries(np.concatenate(names).astype(np.int64)[order], [ids[i] for i in order.tolist()], np.concatenate(points)[order])
                    ready = held, dict(zip(own.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(code)])))
                part = batch.slice(n)
                for a in range(0, part.num_rows, 512):
                    some = part.slice(a, 512)
                    q, found, score = best(*ready, list(zip(matrix(some.column(4)), some.column(7).to_pylist())), k + 1)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(5).take(pa.array(q)), some.column(6).take(pa.array(q)), pa.array(found), pa.array(score)], names=["k1", "k2", "vec_id", "score"]
                    )

    null = F.lit(None).cast
    both = dealt.select("slot", F.lit(0).alias("kind"), "bucket", "ids", "embedding", null("long").alias("k1"), null("long").alias("k2"), null("array<long>").alias("buckets"), "name").unionByName(
        visits.select("slot", F.lit(1).alias("kind"), null("long").alias("bucket"), null("array<long>").alias("ids"), "embedding", "k1", "k2", "buckets", null("long").alias("name"))
    )
    found = both.repartition(tasks, "slot").sortWithinPartitions("kind").mapInArrow(rank_slots, out_schema)
    merged = top(found, k + 1)
    merged = scratch.save(merged, "found")
    few = asked.join(merged.groupBy("k1", "k2").count().where(F.col("count") > min(k, n_ids - 1)), ["k1", "k2"], "left_anti")
    full = whole(entries, few, k, scratch)
    if full is not None:
        merged = top(merged.unionByName(full), k + 1)
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        merged.select("k1", "k2", "vec_id", "score")
        .join(queries.select("k1", "k2", F.col("vec_id").alias("query_id")).distinct(), ["k1", "k2"])
        .where("query_id != vec_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top(found: DataFrame, n: int) -> DataFrame:
    """The n best vec_ids of each query, each by its best score."""
    order = W.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    each = found.groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def whole(entries: DataFrame, few: DataFrame, k: int, scratch: Scratch, block: int = 1024) -> DataFrame | None:
    """Queries whose buckets held too few entries, against all entries: the
    queries go around in blocks of fixed size, each block's result is written."""
    spark = entries.sparkSession
    few = scratch.save(few, "few")
    blocks = -(-few.count() // block)
    out = None
    for b in range(blocks):
        some = few.where(F.pmod("k1", F.lit(blocks)) == b).collect()  # about ``block`` queries
        if not some:
            continue
        shared = spark.sparkContext.broadcast([(r["k1"], r["k2"], np.array(r["embedding"], dtype=np.float64)) for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            k1, k2 = (np.array([o[j] for o in own], dtype=np.int64) for j in range(2))
            for batch in batches:
                if batch.num_rows:
                    held = Entries(batch.column(2).to_numpy(), batch.column(1).to_pylist(), matrix(batch.column(0)))
                    q, found, score = best(held, {0: (0, batch.num_rows)}, [(v, [0]) for _, _, v in own], k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(k1[q]), pa.array(k2[q]), pa.array(found), pa.array(score)], names=["k1", "k2", "vec_id", "score"])

        rows = entries.select("embedding", "ids", F.xxhash64("embedding").alias("name")).mapInArrow(run, "k1 long, k2 long, vec_id long, score double")
        out = scratch.save(rows, "whole", append=True)
        shared.destroy()
    return out
