import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from granary.llm import lm, trie
from tests.llm.conftest import EDGES


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def brute(rows):
    """Base scores, and the model's without quantisation."""
    training = [tokens(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(x for t in training for x in t)
    total, norm = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    cls = lambda w: w if c[w] else "<other>"
    tri = Counter()
    for t in training:
        x = ["</s>", "</s>", *map(cls, t)]
        tri.update(zip(x, x[1:], x[2:]))
    bi, uni, c3, k3, c2, k2 = (Counter() for _ in range(6))
    for (a, b, w), n in tri.items():
        bi[b, w] += n
        c3[a, b] += n
        k3[a, b] += 1
    for (b, w), n in bi.items():
        uni[w] += n
        c2[b] += n
        k2[b] += 1
    one = lambda w: (uni[w] + 0.5) / norm
    two = lambda b, w: (bi[b, w] + k2[b] * one(w)) / (c2[b] + k2[b]) if c2[b] else one(w)
    three = lambda a, b, w: (tri[a, b, w] + k3[a, b] * two(b, w)) / (c3[a, b] + k3[a, b]) if c3[a, b] else two(b, w)
    out = []
    for d, t in rows:
        own = tokens(t)
        x = ["</s>", "</s>", *map(cls, own)]
        base = sum(math.log10((c[w] + 0.5) / norm) for w in own)
        score = sum(math.log10(three(*x[i : i + 3])) for i in range(len(own)))
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 1, len(own), sum(c[w] > 0 for w in own), total, base, score))
    return out


@pytest.mark.parametrize("frequent", [85, 65_536])
def test_against_brute_force(spark, docs_table, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    words = [f"W{i}" for i in range(60)] + [f"new{i}é" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words[:60] if zlib.crc32(str(i).encode()) % 5 != 1 else words, rng.integers(0, 30)))) for i in range(120)] + [e for e in EDGES if e[0] not in (5,)]
    got = sorted(map(tuple, lm.score(docs_table(rows)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    by = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[2], r[3]))
    for g, w in zip(by(got), by(want), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
        assert abs(g[6] - w[6]) < 0.01 * g[2]


def test_clashing_columns(docs_table, clashing):
    more = clashing.withColumns({c: clashing["score"] for c in ("kind", "a", "b", "held_out", "piece", "base_score")})
    plain = docs_table([(r["doc_id"], r["text"]) for r in clashing.collect()])
    assert sorted(map(tuple, lm.score(more).collect())) == sorted(map(tuple, lm.score(plain).collect()))


def test_without_training_texts(docs_table):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.score(docs_table([(held, "a b c")])).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"])
    assert lm.score(docs_table([])).count() == 0


@pytest.mark.parametrize("n, top", [(1, 0), (5, 0), (1000, 10), (1000, 10**9), (50_000, 3 * 10**6), (70, 2**40)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    assert (trie.EliasFano.build(v).get(np.arange(n)) == v).all()


def test_trie_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    v = 50
    g3 = np.unique(rng.integers(0, v, (3000, 3)), axis=0)
    g2 = np.unique(np.concatenate([g3[:, :2], rng.integers(0, v, (100, 2))]), axis=0)
    levels = [(g, -rng.random(len(g)).round(2), -rng.random(len(g)).round(2)) for g in (np.arange(v)[:, None], g2, g3)]
    trie.to_file(trie.Trie.build(levels, v), str(tmp_path / "t"))
    own = trie.open_file(str(tmp_path / "t"))
    for n, (grams, p, b) in enumerate(levels, 1):
        at = own.find(grams, n)
        assert (at == np.arange(len(grams))).all()
        assert np.array_equal(own.log_p(at, n), p) and np.array_equal(own.backoff(at, n), b)
        some, known = rng.integers(0, v, (2000, n)), {tuple(x) for x in grams.tolist()}
        assert [(a >= 0) for a in own.find(some, n)] == [tuple(x) in known for x in some.tolist()]


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_whole_vocabulary(spark, docs_table, monkeypatch, shard):
    """More words than the table holds; frequent words in several shards, texts in several pieces."""
    monkeypatch.setattr(lm, "SHARD", shard, raising=False)
    monkeypatch.setattr(lm, "FREQUENT", 200)
    monkeypatch.setattr(lm, "PIECE", 100)
    monkeypatch.setattr(lm, "PER_SHARD", 1)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 25), 600))) for i in range(150)]
    rows += [(i + 1000, t) for i, t in rows[:40]] + [(5000, None), (None, "w1 w2")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tri, bi, uni = Counter(), Counter(), Counter()
    lines = [(d, ["</s>", "</s>", *tokens(t)]) for d, t in rows]
    for d, x in lines:
        if not held(d):
            tri.update(zip(x, x[1:], x[2:]))
            bi.update(zip(x[1:], x[2:]))
            uni.update(x[2:])
    assert len(uni) > 228
    c3, k3, c2, k2 = Counter(), Counter(), Counter(), Counter()
    for (a, b, w), n in tri.items():
        c3[a, b] += n
        k3[a, b] += 1
    for (b, w), n in bi.items():
        c2[b] += n
        k2[b] += 1
    one = lambda w: (uni[w] + 0.5) / (sum(uni.values()) + 0.5 * (len(uni) + 1))
    two = lambda b, w: (bi[b, w] + k2[b] * one(w)) / (c2[b] + k2[b]) if c2[b] else one(w)
    three = lambda a, b, w: (tri[a, b, w] + k3[a, b] * two(b, w)) / (c3[a, b] + k3[a, b]) if c3[a, b] else two(b, w)
    want = sorted((str(d), sum(math.log10(three(*x[i : i + 3])) for i in range(len(x) - 2)), len(x) - 2) for d, x in lines)
    got = sorted((str(r["doc_id"]), r["score"], r["n_tokens"]) for r in lm.score(docs_table(rows)).collect())
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[2] == w[2] and abs(g[1] - w[1]) < 0.001 * g[2]
