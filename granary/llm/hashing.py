"""Vectorised hashing of words, windows and shingles over bytes, in numpy.

A string's hash is a polynomial in an odd base modulo 2^64 over random byte
values, finished by a bijective mix; prefix sums give the hash of any
substring in constant time.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_BASE = 0x9E37_79B9_7F4A_7C13
_BACK = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.Generator(np.random.PCG64(20_201)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks of the first bytes of eight, by their number; bytes of a word that isn't digested.
_HEAD, LONG = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64), 256
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Upper-case A to Z to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in order, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def powers(n: int, which: str) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(1 << (n - 1).bit_length(), _BASE if which == "up" else _BACK, dtype=np.uint64)
        step[0] = 1
        _powers[which] = np.cumprod(step, dtype=np.uint64)
    return _powers[which][:n]


def prefix(raw: np.ndarray) -> np.ndarray:
    """C with C[b] - C[a] = base^a x hash of raw[a:b]."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * powers(len(raw), "up"), out=out[1:])
    return out


def between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of raw[a:b], elementwise."""
    return mix((sums[b] - sums[a]) * powers(len(sums), "down")[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8_FEB8_6659_FD93))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, ASCII letters in lower case, and the
    number of words before each text and in all (len(texts) + 1 numbers).

    Words are taken eight bytes at a time, all words at once; those over LONG
    bytes go through a digest."""
    parts = [t.encode() for t in texts]
    raw = LOWER[np.frombuffer(b" " + b" ".join(parts) + b" " * 9, dtype=np.uint8)]
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, size = edge[0::2], edge[1::2] - edge[0::2]
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    hashes = mix(mix(size.astype(np.uint64)) ^ (eight[starts] & _HEAD[np.minimum(size, 8)]))
    more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        hashes[more] = mix(hashes[more] ^ (eight[starts[more] + done] & _HEAD[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        hashes[i] = int.from_bytes(blake2b(raw[starts[i] : starts[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.cumsum([1, *[len(p) + 1 for p in parts]])
    return hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the hashes of its runs of ``size`` words, in order, or of
    all its words if there are fewer; none without words."""
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        rolled[: max(0, n - j)] += hashes[j:] * np.uint64(pow(_BASE, j + 1, 1 << 64))
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(rolled[a : b - size + 1])
        elif b > a:
            few = np.zeros(1, dtype=np.uint64)
            for j in range(b - a):
                few += hashes[a + j : a + j + 1] * np.uint64(pow(_BASE, j + 1, 1 << 64))
            out.append(mix(few + np.uint64(b - a)))
        else:
            out.append(rolled[:0])
    return out
