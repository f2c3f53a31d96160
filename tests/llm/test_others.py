import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bytebpe, decontaminate, nearest, sharding, tokencount
from tests.llm.conftest import EDGES


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = [chr(i) for i in range(0x180)] + list("‐—…€“” \n\t'sdtremvl!?") * 8 + ["́", "İ", "ſ", "K", "中", "😀", "\x1c", "​", "　", "<|endoftext|>", "<|startoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# Edit matching.


def edit(pattern, text):
    row = [0] * (len(text) + 1)
    for x in pattern:
        new = [row[0] + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 70), rng.randint(0, 90)))
        assert decontaminate.myers(p, t) == edit(p, t)


def test_decontaminate_against_brute_force(spark, docs_table, prose, clashing, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 150)  # several blocks
    rng = random.Random(4)
    items = [(i, prose(500 + i, 12)) for i in range(8)] + [(8, None), (9, "  "), (10, "tiny item")]
    rows = []
    for i in range(40):
        item = list(items[i % 8][1])
        for _ in range(rng.choice([0, 1, 2, 4, 9, 14])):
            item[rng.randrange(len(item))] = rng.choice(["", "Q", "xy"])
        rows.append((100 + i, prose(i, 30) + "  " + "".join(item).upper() + "\n" + prose(i + 100, 30) if i % 5 else prose(i, 50)))
    rows += [(141, "a tiny  ITEM."), (142, "atiny item"), *EDGES]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs_table(rows), table).collect()}
    want = {}
    for d, t in rows:
        text = decontaminate.normal(t)
        for k, item in items:
            item = decontaminate.normal(item)
            if len(item) >= decontaminate.SHORT and len(text) < 5000:
                n, _ = edit(item, text)
                if n <= int(len(item) * decontaminate.ERRORS):
                    want[d, k] = n
    want[141, 10] = 0
    assert got == want
    assert len({k[1] for k in want}) >= 6 and any(0 < n for n in want.values())
    kept = decontaminate.keep_clean(docs_table(rows), table)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in {k[0] for k in want})
    assert decontaminate.keep_clean(clashing, table).columns == clashing.columns
    assert decontaminate.keep_clean(clashing, table).first()["matches"] == "own"
    assert decontaminate.contaminated(docs_table(rows), table.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_table([]), table).count() == 0


def test_decontaminate_without_ids(spark, docs_table, prose, monkeypatch):
    """Items without id, equal texts under several ids, an id of several texts."""
    a, b, c = (prose(900 + i, 15) for i in range(3))
    table = spark.createDataFrame([(None, a), (None, b), (None, b), (1, a), (2, c), (2, a + " x")], "item_id long, text string")
    docs = docs_table([(1, a + " and " + b), (2, c), (3, "none of them"), (4, None), (1, a + " and " + b)])
    want = Counter({(1, None): 4, (1, 1): 2, (1, 2): 2, (2, 2): 1})
    for block in (1 << 20, 10):  # one block, a block for each text
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, table).collect()) == want
        assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, table).collect()) == [3, 4]


# Tokens.


@pytest.fixture(scope="module")
def tiktoken_own():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs_table, clashing, tiktoken_own):
    rows = list(enumerate(random_texts(1, 1500))) + [e for e in EDGES if e[0] != 6]
    got = Counter(tuple(r)[:4] for r in bytebpe.digests(docs_table(rows)).collect())
    want = Counter()
    for d, t in rows:
        ids = tiktoken_own.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert bytebpe.digests(docs_table([])).count() == 0
    again = bytebpe.decode(bytebpe.encode(docs_table(rows)), to="again").select((F.col("again") == F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
    assert all(r["same"] for r in again.collect())
    both = bytebpe.decode(bytebpe.encode(clashing))
    assert set(both.columns) == set(clashing.columns) and both.first()["matches"] == "own"


def test_json_and_tiktoken_files_agree(tiktoken_own):
    own = bytebpe.codec(bytebpe.default_vocabulary())
    assert {bytes(b): i for i, b in enumerate(own.bytes) if b} == tiktoken_own._mergeable_ranks


def test_results_on_request(docs_table, clashing):
    row = bytebpe.encode(docs_table([(1, "aé b"), (2, None)]), give=("round_trip", "n_tokens"), names={"n_tokens": "many"}).orderBy("doc_id").collect()
    assert [(r["round_trip"], r["many"] > 0) for r in row] == [(True, True), (True, False)] and "ids" not in row[0].asDict()


def test_offsets_and_split_characters(docs_table):
    row = bytebpe.encode(docs_table([(1, "aé\U0001f9ff b")])).first()
    own = bytebpe.codec(bytebpe.default_vocabulary())
    ids, starts = np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["char_starts"], "<u4")
    at = 0
    raw = "aé\U0001f9ff b".encode()
    for i, s in zip(ids.tolist(), starts.tolist()):
        assert s == sum((b & 0xC0) != 0x80 for b in raw[: at + 1]) - 1
        at += len(own.bytes[i])
    assert row["n_split"] >= 1 and own.decode(ids) == raw
    cut = own.decode_text(ids[: int(np.flatnonzero(np.diff(starts) == 0)[0]) + 1])
    assert cut.endswith("�") and own.decode_text(ids) == raw.decode()
    assert sorted(bytebpe.byte_table().values()) == list(range(256))


def test_cache_turns_over(monkeypatch, tiktoken_own):
    monkeypatch.setattr(bytebpe, "CACHED", 50)
    own = bytebpe.Codec(bytebpe.default_vocabulary())
    for a in range(5):
        texts = random_texts(a % 2, 60) + ["y" * 500]
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [tiktoken_own.encode_ordinary(t) for t in texts]


def test_token_counts(docs_table, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokencount.default_vocabulary())
    rows = list(enumerate(random_texts(2, 1500))) + [e for e in EDGES if e[0] != 6] + [(77, "a b " * 3000)]
    for frequent in (3, 32_768):
        monkeypatch.setattr(tokencount, "FREQUENT", frequent)
        got = Counter(map(tuple, tokencount.counts(docs_table(rows)).collect()))
        want = Counter()
        for d, t in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want[d, len((t or "").encode()), n, n > 2048] += 1
        assert got == want
    assert tokencount.counts(docs_table([])).count() == 0


# Sharding.


def test_exact_uniform_shards(docs_table, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    rows = [(i, f"text {i % 97}") for i in range(100, 1103)] + EDGES
    got = sharding.shuffle_rows(docs_table(rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["size"], by[1]["text_crc32"], by[1]["law"], by[1]["grown_shard"]) == (1, 0, "rows", None)
    assert sharding.shuffle_rows(docs_table([])).count() == 0
    few = sharding.shuffle_rows(docs_table([(1, "a"), (1, "a"), (1, "a")])).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_communication_matrix_has_the_right_law():
    counts = [30, 50, 20]
    first = np.array([sharding.communication_matrix(counts, 2, s)[0, 0] for s in range(3000)])
    # hypergeometric: 30 of 100 rows, 50 places
    assert abs(first.mean() - 15) < 0.15 and abs(first.var() - 30 * 0.5 * 0.5 * 70 / 99) < 0.5
    m = sharding.communication_matrix([10**12, 3 * 10**12 + 5, 7], 8, 1)
    assert m.sum(axis=1).tolist() == [10**12, 3 * 10**12 + 5, 7] and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()


# Nearest neighbours.


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows, k=20):
    live = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in live:
        if q % 20 == 0:
            out[q] = sorted(((-(w * v).sum(), i) for i, w in live if i != q))[:k]
    return out


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(600)]
    twin = rows[40][1]
    rows += [(i, twin, 0) for i in range(1000, 1100)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [1.0] * 15 + [None], 0), (2060, [float("nan")] * 16, 0), (2080, [float("inf")] * 16, 0), (2100, [1.0] * 3, 0), (None, twin, 0), rows[7], rows[20]]
    want = exact({(r[0], tuple(r[1] or ())): r for r in rows}.values())
    monkeypatch.setattr(nearest, "BLOCK", 30)  # crowded buckets are dealt out
    got = {}
    for r in nearest.search(vectors(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    by = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - (by[q] * by[i]).sum()) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    # Equal vectors: the smallest ids, without the query's own.
    assert [i for _, i, _ in got[1000]][:20] == [40, *range(1001, 1020)]


def test_nearest_small_tables(spark):
    rows = [(i, [float(i + 1), 1.0], 0) for i in range(5)]
    got = nearest.search(vectors(spark, rows)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 4, 6.0), (0, 2, 3, 5.0), (0, 3, 2, 4.0), (0, 4, 1, 3.0)]
    assert nearest.search(vectors(spark, [])).count() == 0
    assert nearest.search(vectors(spark, [(1, [1.0, 2.0], 0)])).count() == 0
    assert nearest.search(vectors(spark, [(0, [1.0, 2.0], 0)])).count() == 0


def test_nearest_few_vectors_in_copies(spark):
    rng = np.random.default_rng(4)
    kinds = [[float(x) for x in rng.normal(size=16)] for _ in range(10)]
    got = nearest.search(vectors(spark, [(i, kinds[i % 10], 0) for i in range(50)])).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert ranks and all(sorted(x) == list(range(1, 21)) for x in ranks.values())


def test_nearest_ties(spark):
    """200 different vectors near the query with one inner product: the smallest ids win."""
    rng = np.random.default_rng(6)
    ids = [int(i) for i in rng.permutation(np.arange(1, 4000)) if i % 20][:200]
    rest = rng.normal(size=(200, 15))
    rest *= 1e-3 / np.sqrt((rest**2).sum(axis=1))[:, None]
    rows = [(i, [1.0, *map(float, r)], 0) for i, r in zip(ids, rest)] + [(0, [1.0] + [0.0] * 15, 0)]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in nearest.search(vectors(spark, rows)).collect() if r["query_id"] == 0)
    assert got == [(k, i, 1.0) for k, i in enumerate(sorted(ids)[:20], 1)]


def test_best_selects_by_score_and_id():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        points = rng.integers(-1, 2, (n, 4)).astype(float)
        ids = [sorted(rng.choice(200, int(rng.integers(1, 4)), replace=False).tolist()) for _ in range(n)]
        held = nearest.Entries(np.arange(n), ids, points)
        cut = int(rng.integers(0, n + 1))
        spans = {1: (0, cut), 2: (cut, n), 3: (0, n)}
        queries = [(rng.integers(-1, 2, 4).astype(float), [1, 2, 3]) for _ in range(3)]
        got = list(zip(*nearest.best(held, spans, queries, k)))
        for q, (v, _) in enumerate(queries):
            score = {}
            for own, p in zip(ids, points):
                for i in own:
                    score[i] = max(score.get(i, -99.0), float(v @ p))
            want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [(int(i), float(s)) for w, i, s in got if w == q] == want


def test_nearest_few_vectors_many_rows(spark):
    rows = [(i, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]][i % 3], 0) for i in range(34)] + [(3, [9.0, 9.0], 0)]
    got = {}
    for r in nearest.search(vectors(spark, rows).withColumns({c: F.lit("own") for c in ("slot", "ids", "name", "bucket", "k1", "rank", "score")})).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20} and all(len(x) == 20 for x in got.values())
    # vec_id 3 has two vectors and keeps its best score
    assert sorted(got[20])[0] == (1, 3, 18.0) and sorted(got[0])[0] == (1, 3, 9.0)
