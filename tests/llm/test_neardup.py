import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from granary.llm import neardup
from granary.llm.dart import signatures
from granary.llm.graph import components
from granary.llm.shared import Scratch
from tests.llm.conftest import EDGES


def brute(rows):
    """Class by row number: rows without words are alone."""
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if w:
            sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(sets, 2):
        both = sum((sets[i] & sets[j]).values())
        if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
            parent[root(j)] = root(i)
    return [root(i) for i in range(len(rows))]


def cases(prose):
    rng = random.Random(1)
    rows = []
    for i in range(12):
        base = prose(i, 80).split()
        for c in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(999)}"
            rows.append((len(rows) + 10, " ".join(own)))
    rows += [(900, prose(0, 80)), (901, prose(0, 80)), (902, "one two three"), (903, "One  two\nthree"), (904, "one two four"), (905, "a b c d e " * 50), (906, "a b c d e " * 49)]
    return rows + EDGES


def test_against_brute_force(docs_table, prose):
    rows = cases(prose)
    got = neardup.near_duplicates(docs_table(rows)).collect()
    assert len(got) == len(rows)
    roots = brute(rows)
    want = Counter()
    members = {}
    for (d, _), r in zip(rows, roots):
        members.setdefault(r, []).append(d)
    for v in members.values():
        least = min((x for x in v if x is not None), default=None)
        want.update((d, least, len(v)) for d in v)
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want


def test_drop_duplicates(docs_table, prose, clashing):
    rows = cases(prose)
    kept = neardup.drop_duplicates(docs_table(rows)).collect()
    assert len(kept) == len(set(brute(rows)))
    assert neardup.drop_duplicates(clashing).columns == clashing.columns
    assert neardup.drop_duplicates(docs_table([])).count() == 0


def test_large_bucket_in_parts(docs_table, prose, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 8)
    base = prose(3, 120).split()
    rows = [(i, " ".join([*base[:60], f"v{i}", *base[60:]])) for i in range(60)]
    got = neardup.near_duplicates(docs_table(rows)).collect()
    assert {r["class_id"] for r in got} == {0} and got[0]["class_size"] == 60


@pytest.mark.parametrize("n, shared", [(50, 40), (400, 300), (3, 2)])
def test_signatures_estimate_weighted_jaccard(n, shared):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
    weights = rng.integers(1, 6, len(ids))
    a, b = slice(0, n), slice(n - shared, None)
    other = weights.copy()
    other[n - shared : n - shared // 2] += 2
    x, y = dict(zip(ids[a].tolist(), weights[a].tolist())), dict(zip(ids[b].tolist(), other[b].tolist()))
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
    s = signatures([(ids[a], weights[a]), (ids[b], other[b]), (ids[:0], weights[:0])], 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert not s[2].any()


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{rng.randrange(9)}", f"m{rng.randrange(9)}") for _ in range(30)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()}
    assert {got[f"n{i}"] for i in range(41)} == {"n0"}
    assert {got[f"s{i}"] for i in range(50)} == {"hub"} and got["hub"] == "hub"
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "t")).count() == 0


def test_links_between_parts(docs_table, prose, monkeypatch):
    """A template under the similarity, whose only true pairs lie in different parts of large buckets."""
    monkeypatch.setattr(neardup, "PART", 4)
    base = prose(5, 104)
    rows = []
    for i in range(60):
        pair = f"p{i // 2} q{i // 2}" if i < 24 else f"r{i} s{i}"
        rows.append((i, " ".join([base, pair, *[f"t{i}x{k}" for k in range(12)]])))
    roots = brute(rows)
    assert len(set(roots)) == 48
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_table(rows)).collect()}
    assert got == {i: min(j for j in range(60) if roots[j] == roots[i]) for i in range(60)}
    kept = neardup.drop_duplicates(docs_table(rows)).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == set(got.values())
