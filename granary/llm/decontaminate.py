"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur with up to ``floor(n * errors)`` edits.  Cut
into one piece more than that, at least one piece occurs unchanged.  Pieces are
found by an Aho-Corasick automaton; around each hit a window is verified with
Myers' bit-parallel edit distance.  Both sides are compared in lower case with
runs of white space as one space.

Items are a query set.  Equal texts are searched once.  They go to the workers
in blocks that are cut as soon as they reach BLOCK characters, one narrow pass
over the documents for each block, whose findings are written before the next;
so what is broadcast is bounded by BLOCK and the longest item.  Findings get
their item_ids by a join.

Defined results: null or blank texts and items match nothing; items shorter
than SHORT characters after normalisation must occur unchanged between
non-letters; an item_id that occurs in several rows has each row searched and
the best match kept; rows without item_id are items of their own, each
different text once; repeated document rows each get their matches; other
columns are kept by ``keep_clean``, whatever their names; empty tables give no
matches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import Scratch, fresh, parts

ERRORS, SHORT, BLOCK = 0.06, 24, 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 adjoining pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the
    first end of such a part."""
    m = len(pattern)
    table: dict[str, int] = {}
    for i, c in enumerate(pattern):
        table[c] = table.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = table.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        # the text may start anywhere, so nothing is shifted into the first row
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~((eq | minus) | up)), up & (eq | minus)
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[str], errors: float):
        import ahocorasick

        self.items, self.found = [], ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for text in map(normal, items):
            k = int(len(text) * errors) if len(text) >= SHORT else 0
            self.items.append((text, k))
            if not text:
                continue
            for at, piece in pieces(text, k):
                places.setdefault(piece, []).append((len(self.items) - 1, at))
        for piece, where in places.items():
            self.found.add_word(piece, (len(piece), where))
        if places:
            self.found.make_automaton()
        self.any = bool(places)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's place, distance, start, end) of each item's best match,
        places in the normalised text."""
        if not self.any or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.found.iter(text):
            for n, at in where:
                item, k = self.items[n]
                a = last + 1 - size - at - k
                b = a + len(item) + 2 * k
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        out = []
        for n, own in sorted(spans.items()):
            item, k = self.items[n]
            best = None
            for a, b in own:
                a = max(a, 0)
                if len(item) < SHORT:
                    hit = self.whole(item, text, a, b)
                else:
                    d, end = myers(item, text[a:b])
                    hit = (d, end) if d <= k else None
                if hit is None:
                    continue
                d, end = hit[0], a + hit[1]
                start = end - myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1])[1] if d else end - len(item)
                if best is None or (d, start) < best[:2]:
                    best = d, start, end
            if best is not None:
                out.append((n, *best))
        return out

    @staticmethod
    def whole(item: str, text: str, a: int, b: int) -> tuple[int, int] | None:
        at = text.find(item, a, b)
        while at >= 0:
            before, after = text[at - 1 : at], text[at + len(item) : at + len(item) + 1]
            if not before.isalnum() and not after.isalnum():
                return 0, at + len(item) - a
            at = text.find(item, at + 1, b)
        return None


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Different item texts with their keys, some BLOCK characters at a time."""
    some, size = [], 0
    for row in items.select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"]).toLocalIterator():
        some.append((row["key"], row["text"]))
        size += len(row["text"])
        if size >= BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def usable(items: DataFrame) -> DataFrame:
    return items.where(F.col("text").rlike(r"\S"))


def hits(docs: DataFrame, block: list[tuple[int, str]], errors: float) -> DataFrame:
    """(row, doc_id, key, distance, start, end) from (row, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK characters and an item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher([t for _, t in shared.value], errors)
        for batch in parts(batches):
            found = [(i, *m) for i, t in enumerate(batch.column(2).to_pylist()) for m in own.search(normal(t))]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([shared.value[f[1]][0] for f in found], pa.int64())]
                + [pa.array([f[j] for f in found], pa.int32()) for j in (2, 3, 4)],
                names=["row", "doc_id", "key", "distance", "start", "end"],
            )

    return docs.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, distance int, start int, end int")


def contaminated(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """A row for each document and item found in it: the least distance, and
    the place in the normalised text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    known = usable(items).select(F.col("item_id").cast("long").alias("item_id"), "text")
    scratch, found = Scratch(docs.sparkSession, "decontaminate"), None
    for block in blocks_of(known):
        # Row numbers are those of one plan over one input: they are the same in each pass.
        found = scratch.save(hits(rows, block, errors), "hits", append=True)
    if found is None:
        found = rows.limit(0).select("row", "doc_id", *[F.lit(0).cast(t).alias(c) for c, t in (("key", "long"), ("distance", "int"), ("start", "int"), ("end", "int"))])
    ids = known.select(F.xxhash64("text").alias("key"), "item_id").distinct()
    own = F.when(F.col("item_id").isNull(), F.col("key")).alias("own")
    best = found.join(ids, "key").groupBy("row", "doc_id", "item_id", own).agg(F.min(F.struct("distance", "start", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.distance", "best.start", "best.end")


def keep_clean(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; columns stay."""
    scratch, blocks = Scratch(docs.sparkSession, "decontaminate"), blocks_of(usable(items))
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        return docs
    if more is None:
        return without(docs, block, errors)
    # Several blocks: each writes the addresses of the texts that it finds something in.
    address = F.sha2("text", 256)
    texts = docs.select(F.lit(0).cast("long").alias("row"), address.alias("doc_id"), "text").where(F.col("text").isNotNull())
    dirty = None
    for some in itertools.chain([block, more], blocks):
        dirty = scratch.save(hits(texts, some, errors).select("doc_id").distinct(), "dirty", append=True)
    name = fresh("_address", docs)
    return docs.withColumn(name, address).join(dirty.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


def without(docs: DataFrame, block: list[tuple[int, str]], errors: float) -> DataFrame:
    """The rows without any item of one block, in a narrow pass."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])  # BLOCK characters and an item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(shared.value, errors)
        for batch in parts(batches):
            yield batch.filter(pa.array([not own.search(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
