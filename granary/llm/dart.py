"""DartMinHash: weighted MinHash signatures from hashed darts.

Darts are thrown, by hashes alone, into the half plane weight x rank of each
element with unit density.  The plane is cut into regions between powers of
two on either axis, so that a region's darts are the same for every set that
holds the element.  A dart counts if it lies below the element's weight.  It
names one of k coordinates, and each coordinate keeps its dart of least rank:
two sets agree in a coordinate with the probability of their weighted Jaccard
similarity.  Ranks are visited from below, doubling, until all coordinates of
a set are filled, so a set costs some k log k darts whatever its size.
"""

from __future__ import annotations

import numpy as np

from granary.llm.hashing import mix, uniform

#: Height of the lowest strip of ranks.
FIRST = 1 / 8


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Inverse of the distribution function, for means up to 1."""
    term = np.exp(-mean)
    total, n = term.copy(), np.zeros(len(u), dtype=np.int64)
    for j in range(1, 25):
        more = u >= total
        if not more.any():
            break
        n += more
        term = term * mean / j
        total += term
    return n


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of k numbers for each (elements, whole positive weights); sets
    without elements get zeros."""
    best = np.zeros(len(sets) * k, dtype=np.uint64)
    filled = np.zeros(len(sets) * k, dtype=bool)
    sizes = np.array([len(e) for e, _ in sets])
    if not sizes.sum():
        return best.reshape(-1, k)
    element = np.concatenate([e for e, _ in sets]).astype(np.uint64)
    weight = np.concatenate([w for _, w in sets]).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Strips of weight: [0, 1), [1, 2), [2, 4), ... as far as the element's weight.
    strips = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    low_w = np.where(strip == 0, 0.0, 2.0 ** (strip - 1))
    wide = np.where(strip == 0, 1.0, low_w)
    owner, seed = owner[at], mix(element[at] + strip.astype(np.uint64) * np.uint64(0xA24B_AED4_963E_E407))
    top = weight[at].astype(np.float64)
    band = 0
    while len(owner):
        low = 0.0 if band == 0 else FIRST * 2.0 ** (band - 1)
        high = FIRST * 2.0**band
        cells = np.maximum(1, np.ceil(wide * (high - low))).astype(np.int64)
        cell_of = np.repeat(np.arange(len(owner)), cells)
        cell = np.arange(len(cell_of)) - np.repeat(np.cumsum(cells) - cells, cells)
        key = mix(seed[cell_of] + np.uint64((band + 1) * 0x9FB2_1C65_1E98_DF25 % (1 << 64)) + cell.astype(np.uint64) * np.uint64(0xC2B2_AE3D_27D4_EB4F))
        n = _poisson(uniform(key), (wide * (high - low) / cells)[cell_of])
        dart_cell = np.repeat(np.arange(len(cell_of)), n)
        turn = np.arange(len(dart_cell)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(key[dart_cell] ^ mix((turn + 1).astype(np.uint64)))
        src = cell_of[dart_cell]
        height = (low_w[src] + uniform(mix(dart + np.uint64(1))) * wide[src]) < top[src]
        dart, src, dart_cell = dart[height], src[height], dart_cell[height]
        rank = (cell[dart_cell] + uniform(mix(dart + np.uint64(2)))) / cells[src]  # within the strip, from 0 to 1
        place = owner[src] * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        open_ = ~filled[place]
        place, rank, dart = place[open_], rank[open_], dart[open_]
        order = np.lexsort((rank, place))
        place, dart = place[order], dart[order]
        first = np.ones(len(place), dtype=bool)
        first[1:] = place[1:] != place[:-1]
        best[place[first]] = dart[first]
        filled[place[first]] = True
        going = ~filled.reshape(-1, k).all(axis=1)[owner]
        if not going.all():
            owner, seed, top, wide, low_w = owner[going], seed[going], top[going], wide[going], low_w[going]
        band += 1
    return best.reshape(-1, k)
