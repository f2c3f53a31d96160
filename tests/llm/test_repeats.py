import hashlib
import random
import re

import numpy as np
import pytest

from granary.llm import repeats
from granary.llm.suffix import common_prefixes, suffix_array
from tests.llm.conftest import EDGES


def brute(rows):
    least = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raws:
        for i in range(len(b) - 49 if d is not None else 0):
            k = b[i : i + 50]
            least[k] = min(least.get(k, d), d)
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if d is not None else 0):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(prose):
    shared = [prose(100 + i, 20) for i in range(4)]
    rng = random.Random(5)
    rows = []
    for i in range(40):
        parts = [prose(i * 10 + j, 15) for j in range(3)] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i, (" " if i % 2 else "é").join(parts)))
    whole = prose(999, 60)
    rows += [(100 + i, whole) for i in range(3)] + [(50, whole[3:200]), (51, whole[:49]), (52, whole[:50]), (53, "ab" * 300), (54, "b" + "ab" * 100), (54, "b" + "ab" * 100), (None, whole), (None, whole)]
    return rows + [e for e in EDGES if e[0] != 5] + [(8, "x" * 70)]


@pytest.mark.parametrize("hot", [8192, 1], ids=["runs", "strings"])
def test_against_brute_force(docs_table, prose, hot):
    rows = cases(prose)
    got = sorted((tuple(r) for r in repeats.digests(docs_table(rows).repartition(3), hot, 3000).collect()), key=str)
    assert got == brute(rows)


def test_empty(docs_table):
    assert repeats.digests(docs_table([])).count() == 0
    assert [tuple(r)[:4] for r in repeats.digests(docs_table([(1, None)])).collect()] == [(1, 0, 0, 0)]


@pytest.mark.parametrize("n, kinds", [(1, 1), (2, 1), (30, 1), (100, 2), (300, 3), (500, 1), (400, 30)])
def test_suffix_array_and_prefixes(n, kinds):
    raw = np.random.default_rng(n + kinds).integers(0, kinds, n).astype(np.uint8)
    b = raw.tobytes()
    order = suffix_array(raw)
    assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
    for k, m in enumerate(common_prefixes(raw, order)[1:].tolist(), 1):
        x, y = b[order[k - 1] :], b[order[k] :]
        assert x[:m] == y[:m] and (len(x) == m or len(y) == m or x[m] != y[m])
