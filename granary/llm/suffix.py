"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes,
vectorised in numpy."""

from __future__ import annotations

import numpy as np


def packed(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number, zeros after the
    end."""
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(raw)].copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order.

    A group's number is the place of its last member in the order, so a group
    of one is final and is not looked at again; each round sorts the others'
    members by the group of the suffix that starts where the known order ends.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64)
    words = packed(raw)
    order = np.argsort(words).astype(np.int64)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    # Zeros after the end must not equal zero bytes: shorter suffixes stand apart, first.
    tail = order[order > n - 8]
    same = np.zeros(n, dtype=bool)
    same[1:] = words[order[1:]] == words[order[:-1]]
    if len(tail):
        length = np.minimum(n - order, 8)
        redo = np.lexsort((length, words[order]))
        order, length = order[redo], length[redo]
        same[1:] = (words[order[1:]] == words[order[:-1]]) & (length[1:] == length[:-1]) & (length[1:] == 8)
    rank[order] = _last(same)
    known = 8
    todo = _members(same)
    while len(todo):
        own = order[todo]
        group, after = rank[own], rank[np.minimum(own + known, n)]
        both = group * (n + 1) + after + 1  # under 2^63 for texts under 3 GB
        redo = np.argsort(both)
        own, both = own[redo], both[redo]
        order[todo] = own
        same = np.zeros(len(todo), dtype=bool)
        same[1:] = both[1:] == both[:-1]
        last = _last(same)
        rank[own] = todo[last]
        todo = todo[_members(same)]
        known *= 2
    return order


def _last(same: np.ndarray) -> np.ndarray:
    """For each place the last place of its group."""
    ends = np.flatnonzero(np.append(~same[1:], True))
    return np.repeat(ends, np.diff(np.append(-1, ends)))


def _members(same: np.ndarray) -> np.ndarray:
    """Places in groups of more than one."""
    return np.flatnonzero(same | np.append(same[1:], False))


def common_prefixes(raw: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` and the one
    before it (0 for the first).

    Kasai: going through the text, the length falls by one at most from place
    to place, and by exactly one where the bytes before agree.  So only places
    where they differ are compared, eight bytes at a time, all at once; the
    others follow from the last such place.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    free = (before <= 0) | (place == 0)
    free |= raw[np.maximum(place - 1, 0)] != raw[np.maximum(before - 1, 0)]
    at = np.flatnonzero(free & (before >= 0))
    words = packed(raw)
    length = np.zeros(len(at), dtype=np.int64)
    going = np.arange(len(at))
    while len(going):
        i, j = at[going] + length[going], before[at[going]] + length[going]
        inside = (i < n) & (j < n)
        going, i, j = going[inside], i[inside], j[inside]
        differ = words[i] ^ words[j]
        # Leading zero bytes of the difference.
        top = np.zeros(len(differ), dtype=np.int64)
        for width in (32, 16, 8):
            high = (differ >> np.uint64(64 - width)) == 0
            top += np.where(high, width // 8, 0)
            differ = np.where(high, differ << np.uint64(width), differ)
        top = np.where(differ == 0, 8, top)
        length[going] += np.minimum(top, n - np.maximum(i, j))
        going = going[(top == 8)]
    reach = np.zeros(n, dtype=np.int64)
    reach[at] = length + at
    plcp = np.maximum(np.maximum.accumulate(reach) - place, 0)
    plcp[order[0]] = 0
    return plcp[order]
