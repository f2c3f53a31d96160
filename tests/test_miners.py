import math
import random

import pytest

from granary.operators import bigfim, fin
from granary.plans import miners

VARIANTS = [
    ("FP_GROWTH", {}),
    ("APRIORI", {}),
    ("ECLAT", {"diffsets": True}),
    ("ECLAT", {"diffsets": False, "squeeze": True}),
    ("ECLAT", {"class_rows": 3}),
    ("BIG_FIM", {}),
    ("BIG_FIM", {"prefix_len": 1}),
    ("BIG_FIM", {"prefix_len": 2, "ratio": 0.5, "diffsets": False}),
    ("FIN", {}),
    ("FIN", {"groups": 3}),
    ("FIN", {"mode": "SEQ_SPARK", "seq_len": 1}),
    ("FIN", {"mode": "SEQ_SPARK", "seq_len": 3}),
    ("FIN", {"mode": "SEQ_PURE_JAVA"}),
]


def table(spark, baskets):
    return spark.createDataFrame(list(enumerate(baskets)), "tid long, items array<string>")


def brute(baskets, s):
    sets = [set(b or ()) - {None} for b in baskets]
    least = math.ceil(len(sets) * s)
    items = sorted(set().union(*sets)) if sets else []
    out, level = {}, [()]
    while level:
        longer = []
        for base in level:
            for i in items:
                if not base or i > base[-1]:
                    n = sum(set((*base, i)) <= x for x in sets)
                    if n >= least:
                        out[(*base, i)] = n
                        longer.append((*base, i))
        level = longer
    return out


def mined(spark, baskets, s, miner, options):
    rows = miners.mine(table(spark, baskets).persist(), s, miner, **options).collect()
    found = {tuple(r["items"]): r["freq"] for r in rows}
    assert len(found) == len(rows)
    return found


def random_baskets(seed, n, items, density):
    rng = random.Random(seed)
    return [[f"i{k}" for k in range(items) if rng.random() < density * (1 - k / items / 2)] for _ in range(n)]


CASES = [
    (random_baskets(1, 60, 8, 0.6), 0.2),
    (random_baskets(2, 64, 7, 0.8), 0.55),
    ([["a", "a", "b"], None, [], ["b", None, "a"], ["c"]], 0.4),
]


@pytest.mark.parametrize("miner, options", VARIANTS, ids=[f"{m}-{o}" for m, o in VARIANTS])
def test_against_brute_force(spark, miner, options):
    for baskets, s in CASES:
        assert mined(spark, baskets, s, miner, options) == brute(baskets, s)


@pytest.mark.parametrize("miner", ["FP_GROWTH", "APRIORI", "ECLAT", "BIG_FIM", "FIN"])
@pytest.mark.parametrize("baskets", [[["x"], ["y"]], [["a"], ["a", "b"]], [["q", "r"]]], ids=["none", "one item", "one transaction"])
def test_tiny(spark, miner, baskets):
    assert mined(spark, baskets, 1.0, miner, {}) == brute(baskets, 1.0)


@pytest.mark.parametrize("n", [64, 128])
def test_whole_words_of_transactions(spark, n):
    baskets = random_baskets(n, n, 5, 0.95)
    for miner, options in (("ECLAT", {}), ("BIG_FIM", {"prefix_len": 2})):
        assert mined(spark, baskets, 0.5, miner, options) == brute(baskets, 0.5)


def test_all_items_equivalent(spark):
    baskets = [list("abcde")] * 10
    run = miners.start(table(spark, baskets), 0.9)
    assert fin.fin_count(run.encoding) == 31
    closed = fin.closed(run.encoding).collect()
    assert len(closed) == 5  # one for each least frequent item


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="Unknown algorithm"):
        miners.mine(table(spark, [["a"]]), 0.5, "NONE")
    with pytest.raises(ValueError, match="run-type"):
        fin.closed(miners.start(table(spark, [["a"]]), 0.5).encoding, "NONE")


def test_switch_rule():
    p = bigfim.BigFimParams(prefix_len=3, ratio=1.1)
    assert bigfim.keeps_on([19, 125], p)
    assert bigfim.keeps_on([19, 125, 335], p)
    assert not bigfim.keeps_on([19, 125, 335, 551], p)
    assert bigfim.keeps_on([19, 125, 335, 300], p)
    assert not bigfim.keeps_on([19, 1], p)
    assert not bigfim.keeps_on([19, 10], bigfim.BigFimParams(prefix_len=1))


def test_bigfim_result(spark):
    baskets = random_baskets(5, 50, 7, 0.8)
    run = miners.start(table(spark, baskets).persist(), 0.3)
    result = bigfim.mine(run.encoding, bigfim.BigFimParams(prefix_len=1))
    want = brute(baskets, 0.3)
    assert result.counts() == (sum(len(i) <= 2 for i in want), sum(len(i) > 2 for i in want))
    assert result.of_length(2).count() == sum(len(i) == 2 for i in want)
    top = [r["freq"] for r in result.deep_top(3).collect()]
    assert top == sorted((n for i, n in want.items() if len(i) > 2), reverse=True)[:3]
    assert all((r["phase"] == "eclat") == (len(r["itemset"]) > 2) for r in result.all().collect())
    assert result.note
