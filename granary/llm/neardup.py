"""Near-duplicate documents by DartMinHash signatures and banded joining.

Documents are multisets of runs of SHINGLE words (in lower case, split at
white space; fewer words make one run).  Two texts are linked if the weighted
Jaccard similarity of their multisets is SIMILAR or more; classes are the
connected components.

1. Equal texts collapse to one node, on the map side first.
2. Each node gets a DartMinHash signature of BANDS x ROWS coordinates; nodes
   that agree in all rows of a band meet in that band's bucket.  Two texts of
   similarity 0.8 miss each other with a chance of 1e-4.
3. Buckets with the same members count once.  Members of a bucket are checked
   on their whole multisets (as sets of 32-bit hashes): each in turn is compared with all members outside its own component
   whose signatures agree well enough, and linked to its bucket's component;
   a bucket emits one link per member, never all pairs.  A bucket beyond PART
   members is dealt over tasks; then the members that are still outside its
   largest component meet all other members, block against block, each pair of
   blocks in its own task.  So every pair that shares a bucket is compared or
   is in one component already, whatever the bucket's size.
4. Components of the links are found by star rounds over tables.

Results by row: a text that is null or has no words is in a class of its own;
``class_id`` is the least doc_id in the class (null if all are null); repeated
rows are in one class.  ``drop_duplicates`` keeps one row of each class: the
least doc_id, and one only of rows that repeat.  Extra columns are kept by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.dart import signatures
from granary.llm.graph import components
from granary.llm.hashing import mix, shingles, words
from granary.llm.shared import Scratch, fresh, parts

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 5
#: Members of a bucket, or of a block of it, that one task holds; agreement of signatures below
#: which a pair isn't compared: over five standard deviations under SIMILAR.
PART, AGREE = 2048, 0.6
#: Texts that are hashed at a time, in characters.
CHUNK = 1 << 18


def node_of(text: Column) -> Column:
    """The text's address, 128 bits in hex; null if it has no words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.substring(F.sha2(text, 256), 1, 32))


def sets_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, bounds = words(texts)
    return [np.unique(x, return_counts=True) for x in shingles(hashes, bounds, SHINGLE)]


def elements(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set, n-th occurrences apart; 32 bits each, ascending.
    The similarity of multisets is that of these sets."""
    shingle, n = found
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique((mix(np.repeat(shingle, n) + mix(turn.astype(np.uint64))) >> np.uint64(32)).astype("<u4"))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 - start >= 128:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bands_of(nodes: DataFrame) -> DataFrame:
    """(node, bands): a number for each band, from (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                own = signatures(sets_of(texts[a:b]), BANDS * ROWS).reshape(-1, BANDS, ROWS)
                key = np.zeros(own.shape[:2], dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key ^ own[:, :, r])
                key = mix(key + np.arange(BANDS, dtype=np.uint64))
                flat = pa.ListArray.from_arrays(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32), key.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], names=["node", "bands"])

    return nodes.select("node", "text").mapInArrow(run, "node string, bands array<long>")


def payloads(members: DataFrame) -> DataFrame:
    """(node, keys, sig, elements) from (node, text, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                sets = sets_of(texts[a:b])
                sig = (signatures(sets, BANDS * ROWS) & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        pa.array([elements(s).tobytes() for s in sets], pa.binary()),
                    ],
                    names=["node", "keys", "sig", "elements"],
                )

    return members.select("node", "text", "keys").mapInArrow(run, f"node string, keys {members.schema['keys'].dataType.simpleString()}, sig binary, elements binary")


def link(sig: np.ndarray, sets: list[np.ndarray], root: np.ndarray | None = None, block: np.ndarray | None = None) -> list[int]:
    """For each member the first member of its component.  Members of one
    ``root`` are linked already; with two ``block``s only pairs across meet."""
    root = np.arange(len(sets)) if root is None else root.copy()
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    hit = np.zeros(len(kinds), dtype=bool)
    for i in range(len(sets)):
        others = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if block is not None:
            others = others[block[others] != block[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(small >= SIMILAR * large)]
        others = others[(sig[others] == sig[i]).mean(axis=1) >= AGREE]
        if not len(others):
            continue
        own = flat[starts[i] : starts[i + 1]]
        hit[own] = True
        for j in others.tolist():
            if root[j] == root[i]:
                continue
            shared = np.count_nonzero(hit[flat[starts[j] : starts[j + 1]]])
            if shared >= SIMILAR * (sizes[i] + sizes[j] - shared):
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
        hit[own] = False
    return root.tolist()


def groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first n columns and lie together."""
    held: list[tuple] = []
    for batch in parts(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:n] != held[0][:n]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def unpacked(sigs: list[bytes], elements: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.stack([np.frombuffer(s, "<u2") for s in sigs]), [np.frombuffer(e, "<u4") for e in elements]


def checked(members: DataFrame) -> DataFrame:
    """(key, a, b, first, sig, elements) from (key, part, node, sig, elements),
    whose parts lie together: a link per member to the first of its component,
    and for each component its first member with its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, 2):
            yield finish(held)

    def finish(held: list[tuple]) -> pa.RecordBatch:
        root = link(*unpacked([h[3] for h in held], [h[4] for h in held]))
        first = [r == i for i, r in enumerate(root)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([h[2] for h in held], pa.string()),
                pa.array([held[r][2] for r in root], pa.string()),
                pa.array([h[2] if f else None for h, f in zip(held, first)], pa.string()),
                pa.array([h[3] if f else None for h, f in zip(held, first)], pa.binary()),
                pa.array([h[4] if f else None for h, f in zip(held, first)], pa.binary()),
            ],
            names=["key", "a", "b", "first", "sig", "elements"],
        )

    return members.select("key", "part", "node", "sig", "elements").mapInArrow(
        run, "key long, a string, b string, first string, sig binary, elements binary"
    )


def across(members: DataFrame) -> DataFrame:
    """(a, b) links of pairs of blocks, from (key, low, high, node, block,
    root, sig, elements) whose pairs lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, 3):
            _, first, known = np.unique([h[5] for h in held], return_index=True, return_inverse=True)
            known = first[known]
            sides = None if held[0][1] == held[0][2] else np.array([h[4] for h in held])
            root = link(*unpacked([h[6] for h in held], [h[7] for h in held]), known, sides)
            found = [(held[i][3], held[r][3]) for i, r in enumerate(root) if r != known[i]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["a", "b"])

    return members.select("key", "low", "high", "node", "block", "root", "sig", "elements").mapInArrow(run, "a string, b string")


def together(members: DataFrame, *by: str) -> DataFrame:
    spark = members.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return members.repartition(n, *by).sortWithinPartitions(*by, "node")


def links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links from (node, text); equal rows may repeat."""
    # Hashing copies again is cheaper than moving texts to find them.
    banded = scratch.save(bands_of(rows).dropDuplicates(["node"]), "bands").select("node", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("n > 1")
    )
    distinct = scratch.save(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    kept = banded.join(distinct.hint("rebalance"), "key").groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("keys"))  # at most BANDS
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))
    full = payloads(texts.join(kept, "node"))
    members = full.select("node", "sig", "elements", F.inline("keys"))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / PART)))
    first = scratch.save(checked(together(dealt, "key", "part")), "first")
    found = first.select("a", "b")
    big = distinct.where(F.col("n") > PART)
    if big.limit(1).count():
        again = first.where(F.col("first").isNotNull()).join(big.select("key"), "key", "left_semi")
        # Where they fill one part, first members meet first: cheap, and leaves little to the pairs of blocks.
        few = again.groupBy("key").count().where(F.col("count") <= PART).select("key")
        heads = again.join(few, "key").select("key", F.lit(0).cast("long").alias("part"), F.col("first").alias("node"), "sig", "elements")
        found = scratch.save(found.unionByName(checked(together(heads, "key", "part")).select("a", "b")).where("a != b").distinct(), "parts")
        found = found.unionByName(blocks(rows, banded.join(big, "key"), found, scratch))
    return found.where("a != b").distinct()


def blocks(rows: DataFrame, members: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The links between components of ``found`` within the large buckets,
    whose ``members`` are (node, key).  All members outside the bucket's
    largest component meet all others: blocks of PART, a task for each pair."""
    roots = components(found, Scratch(scratch.spark, "neardup-parts"))
    own = scratch.save(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "large")
    sizes = own.groupBy("key", "root").agg(F.count("*").alias("n"))
    per = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    per = per.select("key", F.col("top.root").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / PART).alias("r"), F.ceil(F.col("top.n") / PART).alias("q")).where("r > 0")
    draw = F.xxhash64("node", "key")
    rest = F.col("root") != F.col("main")
    placed = own.join(per, "key").withColumn("block", F.when(rest, F.pmod(draw, "r")).otherwise(F.col("r") + F.pmod(draw, "q")))
    met = F.sequence(F.lit(0).cast("long"), F.when(rest, F.col("r") + F.col("q")).otherwise(F.col("r")) - 1)
    pairs = placed.withColumn("other", F.explode(met)).select("key", "node", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    texts = rows.join(own.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    full = scratch.save(payloads(texts.withColumn("keys", F.lit(0))).drop("keys"), "payloads")
    return scratch.save(across(together(pairs.join(full, "node"), "key", "low", "high")), "across")


def classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class_id, class_size, n_texts) for each text with words."""
    rows = docs.select("doc_id", "text").withColumn("node", node_of(F.col("text"))).where(F.col("node").isNotNull())
    linked = components(links(rows.select("node", "text"), scratch), scratch)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    rooted = nodes.join(linked.hint("rebalance"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    return rooted.select("node", "root").join(named.hint("rebalance"), "root").drop("root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, class_id (least doc_id of its class), the
    class's number of documents and of different texts."""
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    found = classes(docs, scratch)
    some = rows.where(F.col("node").isNotNull()).join(found.hint("rebalance"), "node").select("doc_id", "class_id", "class_size", "n_texts")
    none = rows.where(F.col("node").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(1).cast("long").alias("n_texts")
    )
    return some.unionByName(none)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    own = docs.columns
    at = F.col("text")
    worded = docs.where(node_of(at).isNotNull())
    found = classes(docs, scratch)
    node, head, least = (fresh(c, docs) for c in ("_node", "_head", "_class"))
    # The text that holds each class's least doc_id, then one row of that doc_id.
    rows = worded.select("doc_id", node_of(at).alias("node"))
    heads = (
        rows.join(found.hint("rebalance"), "node")
        .where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("class_id")
        .agg(F.min("node").alias("node"))
        .where(F.col("class_id").isNotNull())
    )
    nameless = found.where(F.col("class_id").isNull()).select("class_id", "node")
    heads = heads.unionByName(nameless).select(F.col("class_id").alias(least), F.col("node").alias(head))
    kept = worded.withColumn(node, node_of(at)).join(
        heads, F.col(node).eqNullSafe(F.col(head)) & F.col("doc_id").eqNullSafe(F.col(least)), "left_semi"
    )
    kept = kept.dropDuplicates(["doc_id", node]).select(*own)
    return kept.unionByName(docs.where(node_of(at).isNull()))


#: DuckDB: all pairs of different texts that share a shingle, compared exactly.
ORACLE_SQL = f"""
with recursive d as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
t as (select row_number() over (order by text) as node, text, w, min_id, n from (select text, any_value(w) as w, min(doc_id) as min_id, count(*) as n from d where len(w) > 0 group by text)),
s as (select node, array_to_string(w[i : i + {SHINGLE - 1}], ' ') as shingle, count(*) as m from (select node, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) as i from t) group by all),
z as (select node, sum(m) as size from s group by node),
p as (select a.node as a, b.node as b, sum(least(a.m, b.m)) as shared from s a join s b on a.shingle = b.shingle and a.node < b.node group by all),
e as (select p.a, p.b from p join z x on x.node = p.a join z y on y.node = p.b where shared >= {SIMILAR}::double * (x.size + y.size - shared)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select node, node as root from t union select g.b, r.root from reach r join both_ways g on g.a = r.node),
rooted as (select node, min(root) as root from reach group by node),
class as (select root, min(min_id) as class_id, sum(n)::bigint as class_size, count(*) as n_texts from rooted join t using (node) group by root)
select d.doc_id, c.class_id, c.class_size, c.n_texts from d join t on d.text = t.text join rooted using (node) join class c using (root)
union all select doc_id, doc_id, 1, 1 from d where text is null or len(w) = 0
"""
