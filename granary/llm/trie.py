"""An n-gram trie in Elias-Fano form, memory-mapped from one flat file.

Level n lists the n-grams in order of their contexts.  Per level there are two
monotone sequences in Elias-Fano form: the pointers from each (n-1)-gram to
its range of successors, and the successors' word ids, which are made monotone
by adding to each the last value of the range before (so an id is the value
relative to its context's base).  Probabilities are quantised to 16 bits in each
level.  A lookup walks the levels by context: it
takes the range from the pointers and finds the word by a successor search in
it.  Where many grams are looked up at once, a level's sequences are read into
plain arrays first; else only the values that the search touches are.

All lookups are vectorised over many n-grams at once.
"""

from __future__ import annotations

import contextlib

import numpy as np

#: So many values are kept as they are.
EXACT = 1 << 14


class EliasFano:
    """A monotone sequence: low parts in whole bytes, high parts in unary;
    select by counts for every 64-bit word of the high part."""

    FIELDS = ("head", "low", "high", "rank")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.head, self.low, self.high, self.rank = head, low, high, rank
        self.n, self.bits = int(head[0]), int(head[1])

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        spread = (max(top, 1) // max(n, 1)).bit_length()
        bits = 0 if spread < 4 else 8 if spread < 12 else 16 if spread < 20 else 32
        low = values.astype(LOW[bits]) if bits else np.zeros(0, dtype=np.uint8)
        place = (values >> bits) + np.arange(n)
        marks = np.zeros(((int(place[-1]) >> 6) + 1 if n else 1) * 64, dtype=bool)
        marks[place] = True
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        rank = (np.cumsum(ones) - ones).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(np.array([n, bits], dtype=np.uint64), low, high, rank)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.rank, i, side="right") - 1
        place = word * 64 + _select(self.high[word], i - self.rank[word].astype(np.int64))
        value = (place - i) << self.bits
        return value | self.low[i] if self.bits else value

    def all(self) -> np.ndarray:
        """The whole sequence."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        place -= np.arange(self.n)
        if self.bits:
            place <<= self.bits
            place |= self.low
        return place


#: Types of low parts, by their bits.
LOW = {8: np.uint8, 16: np.uint16, 32: np.uint32}


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) in each word."""
    place = np.zeros(len(words), dtype=np.int64)
    k = k.astype(np.int64).copy()
    words = words.copy()
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        move = k >= below
        k -= np.where(move, below, 0)
        place += np.where(move, width, 0)
        words = np.where(move, words >> np.uint64(width), words)
    return place


class Trie:
    """Levels of grams over word ids; ``log_p`` of a stored gram is that of
    its last word after the others."""

    def __init__(self, arrays: list[np.ndarray]):
        self.vocabulary = int(arrays[0][0])
        self.levels: list[tuple[EliasFano, EliasFano, EliasFano, tuple, tuple]] = []
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rest = arrays[1:]
        while rest:
            pointers, ids, bases = (EliasFano(*rest[j : j + 4]) for j in (0, 4, 8))
            self.levels.append((pointers, ids, bases, (rest[12], rest[13]), (rest[14], rest[15])))
            rest = rest[16:]

    @staticmethod
    def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], vocabulary: int) -> list[np.ndarray]:
        """From (grams, log_p, backoff) by level, grams as rows of n ids in
        lexicographic order, closed under prefixes; level 1 has all ids.
        ``backoff`` is the log of the share that a gram, as a context, leaves
        to shorter contexts."""
        arrays = [np.array([vocabulary], dtype=np.uint64)]
        for n, (grams, *logs) in enumerate(levels, 1):
            if n == 1:
                counts = np.array([len(grams)])
            else:
                # Successors of a context stand together.
                key = _key(grams[:, :-1], vocabulary)
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                counts = np.zeros(len(levels[n - 2][0]), dtype=np.int64)
                counts[np.searchsorted(above, key[first])] = np.diff(np.append(first, len(key)))
            above = _key(grams, vocabulary) if n < len(levels) else None
            pointers = np.concatenate(([0], np.cumsum(counts)))
            word = grams[:, -1].astype(np.int64)
            # Each range starts where the one before ended, so the sequence never falls.
            last = np.where(counts > 0, word[np.maximum(pointers[1:] - 1, 0)] if len(word) else 0, 0)
            bases = np.concatenate(([0], np.cumsum(last)))
            values = word + np.repeat(bases[:-1], counts)
            for sequence in (pointers, values, bases):
                e = EliasFano.build(sequence)
                arrays += [getattr(e, f) for f in EliasFano.FIELDS]
            for x in logs:
                arrays += quantised(x)
        return arrays

    def step(self, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Places in level n of the successors ``word`` of places in the level
        above; -1 where there is none."""
        pointers, ids, bases, _, _ = self.levels[n - 1]
        out = np.full(len(at), -1, dtype=np.int64)
        ok = np.flatnonzero(at >= 0)
        if not ids.n or not len(ok):
            return out
        at, word = at[ok], word[ok].astype(np.int64)
        if n in self.decoded or len(at) * 4 > ids.n:  # many at a time: the level is read once
            start, base, values = self.read(n)
            lo, end, want = start[at], start[at + 1], word + base[at]
            # Values never fall, so the search may begin before the range.
            lo = np.maximum(lo, np.searchsorted(values, want))
        else:
            lo, end, want = pointers.get(at), pointers.get(at + 1), word + bases.get(at)
            hi = end.copy()
            # The first value in the range that is not less than the one sought.
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                less = ids.get(mid) < want[open_]
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            values = None
        inside = np.flatnonzero(lo < end)
        found = ids.get(lo[inside]) if values is None else values[lo[inside]]
        hit = inside[found == want[inside]]
        out[ok[hit]] = lo[hit]
        return out

    def read(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if n not in self.decoded:
            pointers, ids, bases, _, _ = self.levels[n - 1]
            self.decoded[n] = pointers.all(), bases.all(), ids.all()
        return self.decoded[n]

    def find(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Places in level n of rows of n ids; -1 where there is none."""
        at = grams[:, 0].astype(np.int64)  # level 1 has all ids
        for j in range(1, n):
            at = self.step(at, grams[:, j], j + 1)
        return at

    def log_p(self, places: np.ndarray, n: int) -> np.ndarray:
        code, cut = self.levels[n - 1][3]
        return cut[code[places]]

    def backoff(self, places: np.ndarray, n: int) -> np.ndarray:
        code, cut = self.levels[n - 1][4]
        return cut[code[places]]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log of the probability of each row's last word after the others,
        by the longest stored context."""
        n = grams.shape[1]
        if n == 1:
            return self.log_p(grams[:, 0], 1)
        context = self.find(grams[:, :-1], n - 1)
        at = self.step(context, grams[:, -1], n)
        out = np.zeros(len(grams))
        out[at >= 0] = self.log_p(at[at >= 0], n)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self.score(grams[rest, 1:])
            known = rest[context[rest] >= 0]
            out[known] += self.backoff(context[known], n - 1)
        return out


def quantised(x: np.ndarray) -> list[np.ndarray]:
    """16-bit codes, and the values they stand for: those that occur where they
    are few, else evenly spaced ones."""
    if len(x) <= EXACT:
        values = np.unique(x) if len(x) else np.zeros(1)
        return [np.searchsorted(values, x).astype(np.uint16), values.astype(np.float64)]
    low, high = float(x.min()), float(x.max())
    step = max(high - low, 1e-9) / 0xFFFF
    return [np.rint((x - low) / step).astype(np.uint16), low + step * np.arange(1 << 16)]


def _key(grams: np.ndarray, vocabulary: int) -> np.ndarray:
    key = np.zeros(len(grams), dtype=np.int64)
    for j in range(grams.shape[1]):
        key = key * vocabulary + grams[:, j]
    return key


def to_file(arrays: list[np.ndarray], path) -> None:
    """Flat: a count, then for each array its type, length and bytes, all in
    units of 8 bytes."""
    kinds = ["uint64", "uint32", "uint16", "uint8", "float64", "int64"]
    with open(path, "wb") if isinstance(path, str) else contextlib.nullcontext(path) as f:
        f.write(np.array([len(arrays)], dtype="<u8").tobytes())
        for a in arrays:
            f.write(np.array([kinds.index(a.dtype.name), len(a)], dtype="<u8").tobytes())
            raw = a.tobytes()
            f.write(raw + bytes(-len(raw) % 8))
        f.flush()


def open_file(path) -> Trie:
    """The trie over a memory map: pages are read when lookups touch them and
    shared by all workers of a machine."""
    kinds = ["uint64", "uint32", "uint16", "uint8", "float64", "int64"]
    raw = np.memmap(path, dtype=np.uint8, mode="r")
    number, at, arrays = int(raw[:8].view("<u8")[0]), 8, []
    for _ in range(number):
        kind, size = raw[at : at + 16].view("<u8").tolist()
        width = np.dtype(kinds[kind]).itemsize
        at += 16
        arrays.append(raw[at : at + size * width].view(kinds[kind]))
        at += size * width + -(size * width) % 8
    return Trie(arrays)
