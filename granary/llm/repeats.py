"""Repeated byte strings across documents, by suffix arrays over shards.

A byte goes if it is covered by a LENGTH-byte string that also starts in a
document with a smaller doc_id.

Documents are packed into shards once; that is the only shuffle of texts.

1. Each LENGTH-byte string has an anchor: the GRAM-byte window in it with the
   least hash, so equal strings have equal anchors.  About one place in
   LENGTH / 2 is an anchor.  Shards send their anchors' hashes, in order, to
   buckets; a bucket merges the shards' lists by binary search and answers
   which anchors occur in more than one document.
2. For those only, shards send the text around: the run of strings that share
   the anchor, each distinct run once, with the least doc_id that holds it.
   A bucket builds the suffix array of its distinct runs (Larsson-Sadakane
   refinement) and Kasai's common prefixes; suffixes with a
   common prefix of LENGTH or more are equal strings, and the least doc_id of
   each such group is the string's.  It answers each shard's runs by binary
   search among the distinct ones.
3. Shards mark the bytes of strings whose least doc_id is below their own.

Suffixes of places without a shared anchor are not sorted: to exchange every
suffix, eight bytes for each byte of text, would take several times the input.

A passage that many documents share arrives once per shard, not per document.
Runs at its edges differ from document to document but share an anchor; for
anchors of more than HOT different runs, the strings of a run go separately,
each to the bucket of its own hash, so that no bucket gathers them.

Defined results: strings are compared as UTF-8 bytes within documents; a null
text is empty; a null doc_id is neither smaller nor larger than any, so such
rows keep all bytes and take none from others; rows of equal doc_id take none
from each other; each row has its result; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import hashing
from granary.llm.hashing import between, mix, powers, prefix
from granary.llm.shared import parts, text_of
from granary.llm.suffix import common_prefixes, suffix_array

LENGTH, GRAM = 50, 16
#: Text bytes in a shard and for each bucket, on average; bytes hashed at a
#: time; different runs of an anchor that make it hot.
SHARD_BYTES, BUCKET_BYTES, CHUNK, HOT = 12 << 20, 2 << 20, 1 << 20, 8192
#: Stands for a null doc_id.
NO_ID = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.num, len(a))]], dtype="<i8")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


_TYPES = {np.dtype(t).num: np.dtype(t) for t in ("u1", "i1", "u2", "i4", "u4", "i8", "u8")}


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        out.append(np.frombuffer(raw, _TYPES[kind], size, at))
        at += size * _TYPES[kind].itemsize
    return out


def runs_in(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """lo, hi, anchor and content hash of the runs in some adjoining documents."""
    sums = prefix(raw)
    m = len(raw) - GRAM + 1
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums), "down")[:m])
    # The least hash, leftmost among equals, in each row of windows of a string.
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    at = (least & np.uint64(0xFFFF_FFFF)).astype(np.int64)
    inside = np.zeros(len(raw) - LENGTH + 1, dtype=bool)
    for a, size in zip(starts.tolist(), sizes.tolist()):
        if size >= LENGTH:
            inside[a : a + size - LENGTH + 1] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(start), np.flatnonzero(stop) + 1
    # Least hashes are small numbers; mixed again, anchors spread evenly over the buckets.
    return lo, hi, mix(hashes[at[lo]]), between(sums, lo, hi - 1 + LENGTH)


class Shard:
    """A shard's documents, in a fixed order, and the anchors of their strings.

    A run is a maximal row of strings with one anchor: their starts are
    lo .. hi - 1, its bytes raw[lo : hi - 1 + LENGTH]."""

    def __init__(self, blobs: list[bytes], chunk: int = CHUNK):
        self.chunk = chunk
        ids, sizes, raw = (np.concatenate(x) for x in zip(*map(unpack, blobs)))
        starts = np.cumsum(sizes) - sizes
        # Spark may hand over the blobs in another order the next time.
        texts = raw.tobytes()
        digest = np.array([int.from_bytes(hashlib.blake2b(texts[a : a + n], digest_size=8).digest(), "little") for a, n in zip(starts.tolist(), sizes.tolist())], dtype=np.uint64)
        order = np.lexsort((digest, ids))
        self.ids, self.sizes = ids[order], sizes[order]
        self.raw = np.frombuffer(b"".join(texts[starts[i] : starts[i] + sizes[i]] for i in order.tolist()), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lo, self.hi, self.anchor, self.content = self.runs()
        self.doc = np.searchsorted(self.starts + self.sizes, self.lo, side="right")
        self.id = self.ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def runs(self) -> tuple[np.ndarray, ...]:
        found, first = [], 0
        while first < len(self.sizes):
            # Some documents at a time; one, if it is long.
            last = max(first + 1, int(np.searchsorted(self.starts + self.sizes, self.starts[first] + self.chunk)))
            a = int(self.starts[first])
            b = int(self.starts[last - 1] + self.sizes[last - 1])
            if b - a >= LENGTH:
                lo, hi, anchor, content = runs_in(self.raw[a:b], self.starts[first:last] - a, self.sizes[first:last])
                found.append((lo + a, hi + a, anchor, content))
            first = last
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors in order, whether each is in several documents here, the
        number of its different runs here at most, and a mark of its run's
        content, 0 if there are several."""
        order = np.argsort(self.anchor)
        anchor, ids, content = self.anchor[order], self.id[order], self.content[order]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        if not len(first):
            return anchor, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.uint16)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        one = np.minimum.reduceat(content, first) == np.maximum.reduceat(content, first)
        runs = np.where(one, 1, np.minimum(np.diff(np.append(first, len(anchor))), 0xFFFF)).astype(np.uint16)
        return anchor[first], several, runs, np.where(one, (content[first] >> np.uint64(48)) | np.uint64(1), 0).astype(np.uint16)

    def pieces(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is sent for runs whose anchor's flag (by distinct anchor) is 1,
        and string by string where it is 2: key, lo, size, doc_id, by piece."""
        names = hashing.distinct(self.anchor)
        flag = flags[np.searchsorted(names, self.anchor)] if len(names) else np.zeros(0, np.uint8)
        whole, apart = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        n = self.hi[apart] - self.lo[apart]
        single = np.repeat(self.lo[apart], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(apart, n)
        lo = np.concatenate([self.lo[whole], single])
        size = np.concatenate([self.hi[whole] - self.lo[whole] + LENGTH - 1, np.full(len(single), LENGTH)])
        content = np.concatenate([self.content[whole], content_of(self.raw, single, np.full(len(single), LENGTH), self.chunk)])
        key = np.concatenate([self.anchor[whole], mix(content[len(whole) :] + np.uint64(1))])
        ids = np.concatenate([self.id[whole], self.id[owner]])
        order = np.lexsort((ids, content, key))
        return key[order], content[order], lo[order], size[order], ids[order]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """In the keys' order, so that a bucket's keys are a slice of sorted ones."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def slices_of(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over a column in order."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(edge, np.append(edge[1:], len(bucket))):
        yield int(bucket[a]), int(a), int(b)


def distinct(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    """First places of equal (key, content), which lie together."""
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])))


def gathered(raw: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return raw[at]


def content_of(raw: np.ndarray, lo: np.ndarray, size: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Hashes of raw[lo : lo + size], elementwise, some at a time."""
    out = np.zeros(len(lo), dtype=np.uint64)
    step = max(1, chunk // (2 * LENGTH))
    for a in range(0, len(lo), step):
        n = size[a : a + step].astype(np.int64)
        ends = np.cumsum(n)
        out[a : a + step] = between(prefix(gathered(raw, lo[a : a + step], n)), ends - n, ends)
    return out


def least_ids(raw: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string of each run, in order, the least doc_id of the runs
    that hold it.  ``raw`` has the runs one after another."""
    order = suffix_array(raw)
    group = np.cumsum(common_prefixes(raw, order) < LENGTH) - 1
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    full = (np.arange(len(raw)) - starts[owner]) + LENGTH <= size[owner]
    eligible = full[order]
    place, group = order[eligible], group[eligible]
    least = np.full(group[-1] + 1 if len(group) else 0, NO_ID, dtype=np.int64)
    np.minimum.at(least, group, ids[owner[place]])
    out = np.empty(len(raw), dtype=np.int64)
    out[place] = least[group]
    return out[full]


def remove_repeats(docs: DataFrame, hot_runs: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """For each row doc_id, its byte counts and what is left: n_bytes,
    n_removed, n_spans, spans (start and end bytes), kept (the bytes).  An anchor
    of more than ``hot_runs`` different runs is dealt string by string; bytes are
    hashed some ``chunk`` at a time."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = max(least, -(-total // SHARD_BYTES)), max(least, -(-total // BUCKET_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            shard = batch.column(2).to_numpy()
            order = np.argsort(shard, kind="stable")
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64)
            out = []
            for s, a, b in slices_of(shard[order]):
                texts = [x.encode() for x in batch.column(1).take(pa.array(order[a:b])).to_pylist()]
                out.append((s, pack(ids[order[a:b]], np.array([len(x) for x in texts], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["shard", "blob"])

    packed = rows.mapInArrow(to_shards, "shard long, blob binary")

    def table(shards: list, buckets: list, blobs: list) -> pa.Table:
        return pa.table({"shard": pa.array(shards, pa.int64()), "bucket": pa.array(buckets, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def send_anchors(group: pa.Table) -> pa.Table:
        own = group.column("shard")[0].as_py()
        names, several, runs, mark = Shard(group.column("blob").to_pylist(), chunk).distinct_anchors()
        out = [(b, pack(names[x:y], several[x:y].view(np.uint8), runs[x:y], mark[x:y])) for b, x, y in slices_of(bucket_of(names, buckets))]
        return table([own] * len(out), [b for b, _ in out], [x for _, x in out])

    def merge_anchors(group: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in group.column("blob").to_pylist()]
        names = hashing.distinct(np.concatenate([x[0] for x in lists]))
        shards, runs, several = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        low, high = np.full(len(names), 0xFFFF, dtype=np.uint16), np.zeros(len(names), dtype=np.uint16)
        places = [np.searchsorted(names, x[0]) for x in lists]
        for at, (_, flag, n, mark) in zip(places, lists):
            shards[at] += 1
            runs[at] += n
            several[at] |= flag.view(bool)
            low[at], high[at] = np.minimum(low[at], mark), np.maximum(high[at], mark)
        # Where all marks agree, the many shards' runs are one and the same.
        hot = (runs > hot_runs) & ((low != high) | (low == 0))
        answer = np.where(hot, 2, (shards > 1) | several).astype(np.uint8)
        return table(group.column("shard").to_pylist(), group.column("bucket").to_pylist(), [pack(answer[at]) for at in places])

    def flags_of(blobs: pa.Table, part: int = 0) -> np.ndarray:
        rows = sorted(zip(blobs.column("bucket").to_pylist(), blobs.column("blob").to_pylist()))
        return np.concatenate([unpack(x)[part] for _, x in rows]) if rows else np.zeros(0, np.uint8)

    def send_runs(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return table([], [], [])
        own = group.column("shard")[0].as_py()
        shard = Shard(group.column("blob").to_pylist(), chunk)
        flags = flags_of(answers)
        key, content, lo, size, ids = shard.pieces(flags)
        first = distinct(key, content)  # ids are in order within, so the first is the least
        key, lo, size, ids = key[first], lo[first], size[first], ids[first]
        names = hashing.distinct(shard.anchor)
        flag_of = {b: (x, y) for b, x, y in slices_of(bucket_of(names, buckets))}
        run_of = {b: (x, y) for b, x, y in slices_of(bucket_of(key, buckets))}
        out = []
        for b in sorted({*flag_of, *run_of}):
            (p, q), (x, y) = flag_of.get(b, (0, 0)), run_of.get(b, (0, 0))
            # The answers go along, so that one reply has all that the shard needs.
            out.append((b, pack(flags[p:q], key[x:y], size[x:y].astype(np.uint8), ids[x:y], gathered(shard.raw, lo[x:y], size[x:y]))))
        return table([own] * len(out), [b for b, _ in out], [x for _, x in out])

    def merge_runs(group: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in group.column("blob").to_pylist()]
        key, size, ids, raw = (np.concatenate([x[j] for x in lists]) for j in (1, 2, 3, 4))
        size = size.astype(np.int64)
        starts = np.cumsum(size) - size
        name = mix(key + mix(content_of(raw, starts, size, chunk)))
        order = np.lexsort((ids, name))
        first = order[distinct(name[order], name[order])]
        strings = size[first] - LENGTH + 1
        begins = np.cumsum(strings) - strings
        # A run that is alone with its anchor shares no string with any other.
        _, kind, n_kind = np.unique(key[first], return_inverse=True, return_counts=True)
        mixed = n_kind[kind] > 1
        answer = np.repeat(ids[first], strings)
        if mixed.any():
            some = first[mixed]
            answer[np.repeat(mixed, strings)] = least_ids(gathered(raw, starts[some], size[some]), size[some], ids[some])
        where = np.searchsorted(name[first], name)  # each shard's runs among the distinct ones
        out, at = [], 0
        for x in lists:
            own = where[at : at + len(x[1])]
            at += len(x[1])
            n_own = strings[own]
            full = answer[np.repeat(begins[own] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())]
            # Runs of equal answers within a run are sent as one.
            edge = np.append(True, full[1:] != full[:-1]) if len(full) else np.zeros(0, bool)
            edge[(np.cumsum(n_own) - n_own)] = True
            at_edge = np.flatnonzero(edge)
            out.append(pack(x[0], n_own.astype(np.uint8), np.diff(np.append(at_edge, len(full))).astype(np.uint8), full[at_edge]))
        return table(group.column("shard").to_pylist(), group.column("bucket").to_pylist(), out)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.binary()), ("kept", pa.binary())]

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({c: pa.array([], t) for c, t in fields})
        shard = Shard(group.column("blob").to_pylist(), chunk)
        key, content, lo, size, ids = shard.pieces(flags_of(answers))
        first = distinct(key, content)
        rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()))
        got = [unpack(x) for _, x in rows]
        gone = np.zeros(len(shard.raw) + 1, dtype=np.int32)
        if len(first):
            spans, least = (np.concatenate([x[j] for x in got]).astype(np.int64) for j in (2, 3))
            # One answer for each string of each distinct run; then each run takes its own, some runs at a time.
            each = np.repeat(least, spans)
            strings = size[first] - LENGTH + 1
            begins = np.cumsum(strings) - strings
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            for a in range(0, len(key), 20_000):
                n_own = size[a : a + 20_000] - LENGTH + 1
                turn = np.arange(n_own.sum()) - np.repeat(np.cumsum(n_own) - n_own, n_own)
                own_id = np.repeat(ids[a : a + 20_000], n_own)
                lower = each[np.repeat(begins[of[a : a + 20_000]], n_own) + turn] < own_id
                hit = (np.repeat(lo[a : a + 20_000], n_own) + turn)[lower & (own_id != NO_ID)]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + LENGTH, -1)
        covered = np.cumsum(gone[:-1]) > 0
        out: dict[str, list] = {c: [] for c, _ in fields}
        for i, a, size_ in zip(shard.ids.tolist(), shard.starts.tolist(), shard.sizes.tolist()):
            own = covered[a : a + size_]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).view(np.int8)))
            out["doc_id"].append(None if i == NO_ID else i)
            out["n_bytes"].append(size_)
            out["n_removed"].append(int(own.sum()))
            out["n_spans"].append(len(edge) // 2)
            out["spans"].append(edge.astype("<u4").tobytes())
            out["kept"].append(shard.raw[a : a + size_][~own].tobytes())
        return pa.table({c: pa.array(out[c], t) for c, t in fields})

    schema = "shard long, bucket long, blob binary"
    by_shard = packed.groupBy("shard")
    answers = by_shard.applyInArrow(send_anchors, schema).groupBy("bucket").applyInArrow(merge_anchors, schema)
    runs = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(send_runs, schema)
    replies = runs.groupBy("bucket").applyInArrow(merge_runs, schema)
    return by_shard.cogroup(replies.groupBy("shard")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans binary, kept binary"
    )


def digests(docs: DataFrame, hot_runs: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""
    return remove_repeats(docs, hot_runs, chunk).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
