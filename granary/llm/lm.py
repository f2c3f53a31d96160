"""Language-model scoring with an Elias-Fano n-gram trie.

Words are runs without ASCII white space, A-Z in lower case; each text ends
with an end token.  Words are known by a 64-bit hash, as usual in such models.

1. Exact counts of all words of the training texts: summed in each task, then
   by a shuffle of (word, count).  The most frequent ones, FREQUENT at most, go
   to all workers, as a table of hashes and counts.
2. Every token goes, with the two words before it, to a shard by the middle
   word, so that a shard holds all that follows its contexts; a word too
   frequent for a shard is dealt further by the word before it, and its bigram
   counts, taken over the whole corpus first, go to each of its shards.  The
   number of shards grows with the corpus; no word and no n-gram is left out.
   What lies in one shard from some texts in a row (a piece) travels as one
   compressed row; pieces grow with the number of shards, so rows stay large.
3. Each shard counts its n-grams of training texts, smooths them by Witten-Bell
   interpolation, builds its own Elias-Fano trie, which it maps into memory,
   and looks up its n-grams of all texts.  Sums by text go back by a shuffle.
4. Words beyond the frequent ones are counted where they stand in the middle,
   which gives their part of the base score; where they stand last, their
   counts come to the shard by a join.

Unigrams have the probabilities of the base score, so a word that is not in
training has half a count.

Defined results: a null text is empty and scores its end token; a null doc_id
is not held out; each row has its own result, so repeated rows repeat (and
count as often in training); without training texts every probability is that
of the smoothing alone; other columns are not read; empty in, empty out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import trie
from granary.llm.hashing import distinct, mix, words
from granary.llm.shared import Scratch, parts, text_of, trim

#: Words of the table that all workers hold, at most (16 bytes each).
FREQUENT = 1 << 20
#: Tokens of a shard, on average; tokens of a piece, at least and at most, and for each shard.
SHARD, PIECE, LARGEST_PIECE, PER_SHARD = 1 << 19, 1 << 18, 1 << 21, 256
#: Characters hashed at a time; distinct keys that a task sums before it sends.
CHUNK, HELD = 1 << 18, 1 << 19
#: The hash that stands for the end token; no word has it but by accident.
END_HASH = np.int64(-0x5EED_0E2D_0E2D_5EED)


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Sums:
    """Counts by key, compacted now and then, in bounded memory."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size > 2 * HELD:
            self.compact()

    def compact(self) -> None:
        if not self.keys:
            return
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.size = [k], [n], len(k)

    def full(self) -> bool:
        if self.size > HELD:
            self.compact()
        return self.size > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.compact()
        out = (self.keys[0].astype(np.int64), self.counts[0]) if self.size else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.counts, self.size = [], [], 0
        return out


def batch_of(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): how often each word, and the end token, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sums()
        for batch in parts(batches):
            own = batch.column(0).to_pylist()
            for a, b in chunks(own):
                held.add(np.append(words(own[a:b])[0].view(np.int64), np.full(b - a, END_HASH)))
                if held.full():
                    yield batch_of(*held.take(), names=["key", "n"])
        yield batch_of(*held.take(), names=["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def ranks(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of numbers below ``size``, and which rows differ from
    the one before in that order."""
    if size ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * size + c
        order = np.argsort(key)
        key = key[order]
        return order, np.append(True, key[1:] != key[:-1])[: len(key)]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, new


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit numbers, a row for each place."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T


def numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class Words:
    """Counts of words by hash; a lookup starts from the hash's leading bits."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def __len__(self) -> int:
        return len(self.hashes)

    @cached_property
    def first(self) -> np.ndarray:
        bits = max(1, len(self).bit_length())
        return np.append(np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(self)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places, -1 for words that are not there."""
        bucket = (hashes >> np.uint64(64 - max(1, len(self).bit_length()))).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(hashes), -1, dtype=np.int32)
        going = np.flatnonzero(at < end)
        while len(going):
            here = at[going]
            hit = self.hashes[here] == hashes[going]
            out[going[hit]] = here[hit]
            at[going] += 1
            going = going[~hit & (here + 1 < end[going])]
        return out


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found, bounds = words(texts)
    return found, np.diff(bounds)


def line_of(values: np.ndarray, size: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words in a line, two ends before each text and one after it;
    and the places of all tokens, the last end of each text among them."""
    n = len(size)
    line = np.full(len(values) + 3 * n, end, dtype=values.dtype)
    token = np.ones(len(line), dtype=bool)
    start = np.cumsum(size + 3) - size - 3
    token[start] = token[start + 1] = False
    word = token.copy()
    word[start + size + 2] = False
    line[word] = values
    return line, np.flatnonzero(token)


class Model:
    """What all workers need: counts of frequent words, and the shards."""

    def __init__(self, table: Words, total: int, distinct: int, keys: np.ndarray):
        self.table, self.total, self.distinct, self.keys, self.shards = table, total, distinct, keys, len(keys)
        self.norm = total + 0.5 * (distinct + 1)
        self.end = int(np.searchsorted(table.hashes, END_HASH.view(np.uint64)))
        #: Places of words that are dealt over several shards, and over how many.
        self.hot = np.flatnonzero(table.counts > SHARD // 2)
        self.split = -(-table.counts[self.hot] * 2 // SHARD)
        self.bits = max(1, len(self.hot).bit_length())
        self.piece = min(max(PIECE, PER_SHARD * self.shards), LARGEST_PIECE)

    def deal(self, word: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Numbers of shards."""
        return (mix(mix(word) + turn) % np.uint64(self.shards)).astype(np.int64)

    def hot_place(self, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the hot words, and which words are hot, by places in the table."""
        if not len(self.hot):
            return np.zeros(len(middle), dtype=np.int64), np.zeros(len(middle), dtype=bool)
        at = np.minimum(np.searchsorted(self.hot, middle), len(self.hot) - 1)
        return at, self.hot[at] == middle

    def shard(self, line: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of tokens at some places in a line of hashes, by the word before each;
        where that is hot, by the one before it too."""
        out = self.deal(line[at - 1], np.uint64(0))
        i, hot = self.hot_place(place[at - 1])
        if hot.any():
            own = at[hot]
            out[hot] = self.deal(line[own - 1], mix(line[own - 2]) % self.split[i[hot]].astype(np.uint64))
        return out

    def shards_of(self, i: int) -> list[int]:
        """Keys of all shards of the i-th hot word."""
        turn = np.arange(self.split[i], dtype=np.uint64)
        return self.keys[np.unique(self.deal(np.repeat(self.table.hashes[self.hot[i]], len(turn)), turn))].tolist()

    def pair_keys(self, i: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Keys of bigrams of hot words: the word's place among them, then hash bits."""
        return ((i.astype(np.uint64) << np.uint64(64 - self.bits)) | (mix(last) >> np.uint64(self.bits))).view(np.int64)

    def heads(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """By text: tokens, known tokens and base score as far as the table goes."""
        owner, n = np.repeat(np.arange(len(size)), size), len(size)
        found = place >= 0
        out = np.zeros(n, dtype=HEAD)
        out["tokens"] = size + 1
        known = found & (self.table.counts[place] > 0)
        out["known"] = np.bincount(owner[known], minlength=n) + (self.table.counts[self.end] > 0)
        logs = np.log10((self.table.counts[place[found]] + 0.5) / self.norm)
        out["base"] = np.bincount(owner[found], weights=logs, minlength=n) + np.log10((self.table.counts[self.end] + 0.5) / self.norm)
        return out

    @cached_property
    def by_rank(self) -> np.ndarray:
        """Places in the table, the most frequent word's first."""
        return np.argsort(-self.table.counts, kind="stable").astype(np.int32)

    @cached_property
    def rank(self) -> np.ndarray:
        """Ranks of the table's places, and the number that stands for a word it lacks."""
        out = np.empty(len(self.table) + 1, dtype=np.int32)
        out[self.by_rank] = np.arange(len(self.table))
        out[-1] = len(self.table)
        return out

    def pieces(self, found: np.ndarray, place: np.ndarray, size: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, packed tokens) of some texts; tokens keep their texts' order.
        Frequent words travel as their ranks, byte by byte, the others whole."""
        lost = np.int32(len(self.table))
        line, at = line_of(found, size, END_HASH.view(np.uint64))
        code, _ = line_of(self.rank[place], size, self.rank[self.end])  # place -1 is the last
        middle, _ = line_of(place, size, np.int32(self.end))
        shard = self.shard(line, middle, at)
        order = np.argsort(shard.astype(np.uint16) if self.shards <= 1 << 16 else shard, kind="stable")
        shard, at = shard[order], at[order]
        text = np.repeat((np.arange(len(size)) * 2 + held).astype(np.int32), size + 1)[order]
        step = np.diff(text, prepend=np.int32(0))
        edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        step[edge] = text[edge]
        columns = [code[at - 2], code[at - 1], code[at]]
        rows = np.concatenate([planes(x)[:3] for x in columns] + [planes(step)])
        rest = np.concatenate([3 * np.flatnonzero(x == lost) + j for j, x in enumerate(columns)])
        rest.sort()
        upto = np.searchsorted(rest, 3 * np.append(edge, len(shard))).tolist()
        rest = line[at[rest // 3] - 2 + rest % 3]
        pack = zstandard.ZstdCompressor(level=1).compress
        edge = [*edge.tolist(), len(shard)]
        for i, (lo, hi) in enumerate(zip(edge, edge[1:])):
            raw = pack(rows[:, lo:hi].tobytes())
            yield int(self.keys[shard[lo]]), len(raw).to_bytes(4, "little") + raw + rest[upto[i] : upto[i + 1]].tobytes()

    def tokens(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places as rows of three, hashes of words that have none, texts, blob) from packed tokens."""
        unpack = zstandard.ZstdDecompressor().decompress
        grams, rest, text = [], [], []
        by_rank = np.append(self.by_rank, np.int32(len(self.table)))
        for blob in blobs:
            n = 4 + int.from_bytes(blob[:4], "little")
            own = np.frombuffer(unpack(blob[4:n]), np.uint8).reshape(13, -1)
            low, middle, high = (own[j:9:3].T.astype(np.int32) for j in range(3))
            grams.append(by_rank[low | middle << 8 | high << 16])
            text.append(np.cumsum(numbers(own[9:]), dtype=np.int32))
            rest.append(np.frombuffer(blob[n:], np.uint64))
        return np.concatenate(grams), np.concatenate(rest), np.concatenate(text), np.repeat(np.arange(len(blobs), dtype=np.int32), [len(t) for t in text])

    def scores(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, place: np.ndarray, hashes: np.ndarray, count: np.ndarray, pairs: tuple) -> np.ndarray:
        """Log probabilities of different grams, in order, by the shard's trie,
        from their counts in training, the words' places, hashes and counts,
        and the counts of hot words' bigrams."""
        with os.fdopen(os.memfd_create("trie"), "w+b") as f:
            trie.to_file(trie.Trie.build(self.levels(a, b, c, n, place, hashes, count, pairs), len(place)), f)
            mapped = trie.open_file(f)
            return np.concatenate([np.zeros(0), *[mapped.score(np.stack([x[i : i + BLOCK] for x in (a, b, c)], axis=1)) for i in range(0, len(a), BLOCK)]])

    def levels(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, place: np.ndarray, hashes: np.ndarray, count: np.ndarray, pairs: tuple) -> list[tuple]:
        """The trie's levels: grams, log probabilities and backoffs."""
        v = len(place)
        one = (count + 0.5) / self.norm
        # Bigrams of the shard's middle words, all of them in training counted here or, for hot words, before.
        order, new = ranks([b, c], v)
        inverse = np.empty(len(order), dtype=np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - 1
        asked = (b.astype(np.int64) * v + c)[order[new]]
        del order, new
        two_n = np.bincount(inverse, weights=n, minlength=len(asked))
        c2 = np.bincount(asked // v, weights=two_n, minlength=v)
        k2 = np.bincount(asked // v, weights=two_n > 0, minlength=v)
        at, hot = self.hot_place(place)
        if hot.any():
            key, total = pairs
            of = (key.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
            c2[hot] = np.bincount(of, weights=total, minlength=len(self.hot))[at[hot]]
            k2[hot] = np.bincount(of, minlength=len(self.hot))[at[hot]]
            mine = np.flatnonzero(hot[asked // v])
            wanted = self.pair_keys(at[asked[mine] // v], hashes[asked[mine] % v])
            where = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            two_n[mine] = np.where(key[where] == wanted, total[where], 0) if len(key) else 0
        # Level 2: those bigrams that occur, and the contexts of trigrams.
        own = n > 0
        n3 = n[own]
        context = a[own].astype(np.int64) * v + b[own]
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        context_of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(context))))
        context = context[first]
        total3 = np.bincount(context_of, weights=n3, minlength=len(first))
        kinds3 = np.bincount(context_of, minlength=len(first)).astype(np.float64)
        level = distinct(np.concatenate([asked[two_n > 0], context]))
        level_n, of_asked = np.zeros(len(level)), np.minimum(np.searchsorted(level, asked), max(len(level) - 1, 0))
        there = two_n > 0
        level_n[of_asked[there]] = two_n[there]
        x, y = level // v, level % v
        some = c2[x] + k2[x]
        two = np.where(some > 0, (level_n + k2[x] * one[y]) / np.maximum(some, 1), one[y])
        back2 = np.zeros(len(level))
        back2[np.searchsorted(level, context)] = np.log10(kinds3 / (total3 + kinds3))
        back1 = np.where(c2 > 0, np.log10(np.maximum(k2, 1) / np.maximum(c2 + k2, 1)), 0.0)
        below = two[of_asked[inverse[own]]] if len(level) else np.zeros(0)
        three = (n3 + kinds3[context_of] * below) / (total3 + kinds3)[context_of]
        return [
            (np.arange(v, dtype=np.int32)[:, None], np.log10(one), back1),
            (np.stack([x, y], axis=1).astype(np.int32), np.log10(two), back2),
            (np.stack([a[own], b[own], c[own]], axis=1), np.log10(three), np.zeros(0)),
        ]


def keys_for(spark, n: int) -> np.ndarray:
    """A key for each of n shards, such that a shuffle by key to n partitions
    gives each its own.  Spark's hash decides, so it is asked."""
    tried = spark.range(0, 24 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    keys = 24 * n + np.arange(n, dtype=np.int64)  # stands for a partition that no number hits
    for r in tried:
        keys[r["p"]] = r["id"]
    return keys


#: Grams that are looked up at a time; unit in which a text's sums travel.
BLOCK, STEP = 1 << 17, 2.0**-12
HEAD = np.dtype([("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("held", "?")])
SUMS = "shard long, kind int, a long, b long, blob binary"
#: Kinds of rows that go to the shards.
LATE, PAIR, TOKENS, ROW = range(4)


def train(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame | None]:
    """The model of the rows that are not held out, and by shard the counts of
    words that the model's table lacks and of hot words' bigrams."""
    spark = docs.sparkSession
    rest = remainder(F.col("doc_id"))
    texts = docs.where(rest.isNull() | (rest != 1)).select(text_of().alias("text"))
    counts = scratch.save(word_counts(texts), "counts")
    # How many words have each count: at most some sqrt(2 x tokens) rows.
    by_count = sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True)
    total, distinct = sum(n * m for n, m in by_count), sum(m for _, m in by_count)
    held = np.cumsum([m for _, m in by_count])
    among = [n for (n, _), m in zip(by_count, held.tolist()) if m <= FREQUENT]
    least = among[-1] if among else (by_count[0][0] + 1 if by_count else 1)
    top = counts.where((F.col("n") >= least) & (F.col("key") != int(END_HASH))).toArrow()  # at most FREQUENT pairs of numbers
    ends = counts.where(F.col("key") == int(END_HASH)).select("n").first()
    table = Words(
        np.append(top["key"].to_numpy(), END_HASH).astype(np.int64).view(np.uint64), np.append(top["n"].to_numpy(), ends[0] if ends else 0).astype(np.int64)
    )
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD), 1)
    model = Model(table, total, distinct, keys_for(spark, shards))
    if distinct <= len(table) and not len(model.hot):
        return model, None
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, Sums()

        def taken() -> pa.RecordBatch:
            key, n = held.take()
            return batch_of(np.full(len(key), PAIR, dtype=np.int32), key, n, names=["kind", "a", "b"])

        for batch in parts(batches):
            some = batch.column(0).to_pylist()
            for x, y in chunks(some):
                found, size = hashes_of(some[x:y])
                line, at = line_of(found, size, END_HASH.view(np.uint64))
                place, _ = line_of(own.table.find(found), size, np.int32(own.end))
                i, hot = own.hot_place(place[at - 1])
                hot &= np.repeat(batch.column(1).slice(x, y - x).to_numpy(zero_copy_only=False), size + 1)
                held.add(own.pair_keys(i[hot], line[at[hot]]))
                if held.full():
                    yield taken()
                late = at[place[at] < 0]
                if len(late):
                    shard, key = own.shard(line, place, late), line[late].view(np.int64)
                    order = np.lexsort((key, shard))
                    shard, key = shard[order], key[order]
                    new = np.append(True, (shard[1:] != shard[:-1]) | (key[1:] != key[:-1]))
                    yield batch_of(np.full(int(new.sum()), LATE, dtype=np.int32), own.keys[shard[new]], key[new], names=["kind", "a", "b"])
        yield taken()

    every = docs.select(text_of().alias("text"), F.coalesce(rest != 1, F.lit(True)).alias("trained"))
    side = scratch.save(every.mapInArrow(run, "kind int, a long, b long"), "side")
    late = side.where(F.col("kind") == LATE).select(F.col("a").alias("shard"), F.col("b").alias("key")).distinct()
    out = late.join(counts, "key").select("shard", F.lit(LATE).alias("kind"), F.col("key").alias("a"), F.col("n").alias("b"))
    if len(model.hot):
        where = spark.createDataFrame([(i, model.shards_of(i)) for i in range(len(model.hot))], "i long, shards array<long>")
        pairs = side.where(F.col("kind") == PAIR).groupBy("a").agg(F.sum("b").alias("b")).withColumn("i", F.shiftrightunsigned("a", 64 - model.bits))
        # As many rows as hot words, which are few.
        out = out.unionByName(pairs.join(F.broadcast(where), "i").select(F.explode("shards").alias("shard"), F.lit(PAIR).alias("kind"), "a", "b"))
    return model, out.withColumn("blob", F.lit(None).cast("binary"))


def shard_sums(rows: DataFrame, shared) -> DataFrame:
    """(a, kind, b, doc_id, blob) from (shard, kind, a, b, blob, doc_id), shards
    together: sums of pieces by text, and rows of texts as they came."""
    kept = ["a", "kind", "b", "doc_id", "blob"]
    schema = rows.select(*kept).schema
    none = pa.nulls(1, rows.limit(0).toArrow().schema.field("doc_id").type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables, held = None, ([], []), []
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))).tolist() if len(shard) else []
            for x, y in zip(edges, [*edges[1:], len(shard)]):
                if now is not None and shard[x] != now:
                    yield from finish(tables, held)
                    tables, held = ([], []), []
                    trim()
                now, part = shard[x], batch.slice(x, y - x)
                if kind[x] in (LATE, PAIR):
                    tables[kind[x]].append((part.column(2).to_numpy(), part.column(3).to_numpy()))
                elif kind[x] == TOKENS:
                    held += zip(part.column(2).to_pylist(), part.column(4).to_pylist())
                else:
                    yield part.select(kept)
        yield from finish(tables, held)
        trim()

    def finish(tables: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        own = shared.value
        late, pairs = (sorted_table(t) for t in tables)
        grams, rest, text, blob = own.tokens([h[1] for h in held])
        names, which = np.unique(rest, return_inverse=True)
        rare = len(own.table)
        grams[grams == rare] += which.astype(np.int32)
        del rest, which
        # Numbers of the words that occur here.
        present = np.zeros(rare + len(names), dtype=bool)
        present[grams.ravel()] = True
        code = np.flatnonzero(present)
        grams = (np.cumsum(present, dtype=np.int32) - 1)[grams]
        known = code < rare
        place = np.where(known, code, -1)
        hashes = np.empty(len(code), dtype=np.uint64)
        hashes[known], hashes[~known] = own.table.hashes[code[known]], names
        trained = text % 2 == 0
        # Words that the table lacks: counted where they stand in the middle, or sent where they stand last.
        count = np.bincount(grams[:, 1], weights=trained, minlength=len(code))
        count[known] = own.table.counts[code[known]]
        if len(late[0]):
            wanted = hashes[~known].view(np.int64)
            at = np.minimum(np.searchsorted(late[0], wanted), len(late[0]) - 1)
            count[~known] = np.maximum(count[~known], np.where(late[0][at] == wanted, late[1][at], 0))
        order, new = ranks([grams[:, 0], grams[:, 1], grams[:, 2]], len(code))
        order = order.astype(np.int32)
        a, b, c = grams[order[new]].T
        middle = grams[:, 1].copy()
        del grams
        n = np.add.reduceat(trained[order].astype(np.int64), np.flatnonzero(new))
        each = own.scores(a, b, c, n, place, hashes, count, pairs)
        log = np.empty(len(order))
        log[order] = each[np.cumsum(new, dtype=np.int32) - 1]
        del order, new, each, a, b, c, n
        # Sums by text of each piece.
        lost = ~known[middle]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (blob[1:] != blob[:-1])))
        sums, of = np.add.reduceat(log, first), text[first] >> 1
        lost_n = np.add.reduceat(lost.astype(np.int64), first)
        base = np.add.reduceat(np.where(lost, np.log10((count + 0.5) / own.norm)[middle], 0.0), first)
        seen = np.add.reduceat((lost & (count > 0)[middle]).astype(np.int64), first)
        edge = np.searchsorted(blob[first], np.arange(len(held) + 1))
        for i, (piece, _) in enumerate(held):
            x, y = edge[i], edge[i + 1]
            packed = pack_sums(of[x:y], sums[x:y], lost_n[x:y], seen[x:y], base[x:y])
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([TOKENS], pa.int32()), pa.array([0]), none, pa.array([packed])], names=kept)

    return rows.mapInArrow(run, schema)


def sorted_table(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate([np.zeros(0, np.int64), *[r[j] for r in rows]]) for j in (0, 1))
    order = np.argsort(key)
    return key[order], n[order]


def pack_sums(of: np.ndarray, score: np.ndarray, lost: np.ndarray, seen: np.ndarray, base: np.ndarray) -> bytes:
    """Scores in steps of STEP, everything byte by byte; base scores whole."""
    steps = np.rint(score / STEP)
    head = zstandard.ZstdCompressor(level=1).compress(np.concatenate([planes(x) for x in (np.diff(of, prepend=0), lost, seen, steps)]).tobytes())
    return len(head).to_bytes(4, "little") + head + base[lost > 0].astype("<f8").tobytes()


def unpack_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = 4 + int.from_bytes(raw[:4], "little")
    head = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4:n]), np.uint8).reshape(16, -1)
    of, lost, seen, steps = (numbers(head[j : j + 4]) for j in (0, 4, 8, 12))
    base = np.zeros(len(of))
    base[lost > 0] = np.frombuffer(raw[n:], "<f8")
    return np.cumsum(of), steps * STEP, seen, base


def by_text(sums: DataFrame, kind: str, total: int) -> DataFrame:
    """The result from (a, kind, b, doc_id, blob): a piece's sums come first,
    then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, columns = None, np.zeros((3, 0))
        for batch in batches:
            piece, what = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (what[1:] != what[:-1]))).tolist() if len(piece) else []
            for x, y in zip(edges, [*edges[1:], len(piece)]):
                if piece[x] != now:
                    now, columns = piece[x], np.zeros((3, 0))
                if what[x] == TOKENS:
                    for raw in batch.column(4).slice(x, y - x).to_pylist():
                        of, *own = unpack_sums(raw)
                        if of[-1] >= columns.shape[1]:
                            columns = np.append(columns, np.zeros((3, 2 * int(of[-1]) + 1 - columns.shape[1])), axis=1)
                        for j in range(3):
                            columns[j, of] += own[j]
                else:
                    at = batch.column(2).slice(x, y - x).to_numpy()
                    head = np.frombuffer(b"".join(batch.column(4).slice(x, y - x).to_pylist()), HEAD)
                    score, seen, base = columns[:, at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(3).slice(x, y - x),
                            pa.array(head["held"]),
                            pa.array(head["tokens"]),
                            pa.array(head["known"] + seen.astype(np.int64)),
                            pa.array(np.full(y - x, total)),
                            pa.array(head["base"] + base),
                            pa.array(score),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return sums.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    model, more = train(docs, scratch)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held, tokens = [], 0
        for batch in parts(batches):
            texts = batch.column(3).to_pylist()
            for x, y in chunks(texts):
                found, size = hashes_of(texts[x:y])
                place = own.table.find(found)
                flags = batch.column(2).slice(x, y - x).to_numpy(zero_copy_only=False)
                head = own.heads(place, size)
                head["held"] = flags
                row = batch.column(0).slice(x, y - x).to_numpy()
                # A piece has the number of its first row.
                held.append((row, found, place, size, flags))
                piece = int(held[0][0][0])
                n = len(row)
                raw = head.tobytes()
                blobs = [raw[i : i + HEAD.itemsize] for i in range(0, len(raw), HEAD.itemsize)]
                yield rows_of(np.full(n, own.keys[piece % own.shards]), ROW, piece, sum(len(h[0]) for h in held[:-1]) + np.arange(n), blobs, batch.column(1).slice(x, y - x))
                tokens += len(found) + n
                if tokens >= own.piece:
                    yield dealt(own, held)
                    held, tokens = [], 0
        if held:
            yield dealt(own, held)

    def dealt(own: Model, held: list[tuple]) -> pa.RecordBatch:
        piece = int(held[0][0][0])
        _, found, place, size, flags = (np.concatenate(x) for x in zip(*held))
        out = list(own.pieces(found, place, size, flags))
        return rows_of(np.array([s for s, _ in out]), TOKENS, piece, np.zeros(len(out), np.int64), [r for _, r in out], pa.nulls(len(out), id_type))

    def rows_of(shard: np.ndarray, what: int, piece: int, b: np.ndarray, blobs: list[bytes], ids: pa.Array) -> pa.RecordBatch:
        n = len(shard)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard), pa.array(np.full(n, what, dtype=np.int32)), pa.array(np.full(n, piece)), pa.array(b), pa.array(blobs, pa.binary()), ids],
            names=["shard", "kind", "a", "b", "blob", "doc_id"],
        )

    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out.alias("held_out"), text_of().alias("text"))
    every = rows.mapInArrow(run, f"{SUMS}, doc_id {kind}")
    if more is not None:
        every = every.unionByName(more, allowMissingColumns=True)
    names = ["shard", "kind", "a", "b", "blob", "doc_id"]
    placed = every.repartition(model.shards, "shard").sortWithinPartitions("shard", "kind").select(*names)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return by_text(shard_sums(placed, shared).repartition(tasks, "a").sortWithinPartitions("a", "kind"), kind, model.total)
