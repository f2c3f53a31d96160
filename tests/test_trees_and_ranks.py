from granary.operators import ppc, ranks, results, vertical

FIRST = [[0, 1, 2, 3], [0, 5], [0, 1, 3, 4], [1, 2, 3, 4, 5]]
MORE = [[0, 1, 2], [0, 5, 6], [0, 5], [2, 3]]


def tree(spark, rows):
    return ppc.tree(spark.createDataFrame([(0, r, 1) for r in rows], "gid int, r array<int>, w long"))


def at(nodes, *path):
    r = ppc.node_at(nodes, *path).first()
    return None if r is None else (r["cnt"], r["pre"], r["post"])


def test_prefix_tree(spark):
    nodes = tree(spark, FIRST).persist()
    root = ppc.root(nodes).first()
    assert (root["cnt"], root["pre"], root["post"]) == (0, 1, 13)
    assert at(nodes, 0, 1) == (2, 3, 5)
    assert at(nodes, 1) == (1, 9, 12)
    assert at(nodes, 1, 2) == (1, 10, 11)
    assert at(nodes, 1, 2, 3) == (1, 11, 10)
    assert at(nodes, 1, 2, 3, 4) == (1, 12, 9)
    assert at(nodes, 1, 2, 3, 4, 5) == (1, 13, 8)
    assert at(nodes, 7) is None


def test_merge_of_trees(spark):
    a, b = tree(spark, FIRST), tree(spark, MORE)
    got = {tuple(r["prefix"]): r["cnt"] for r in ppc.merge(a, b).collect()}
    for path, n in {(0,): 6, (0, 1): 3, (0, 1, 2): 2, (0, 1, 2, 3): 1, (0, 5): 3, (0, 5, 6): 1, (2,): 1, (2, 3): 1}.items():
        assert got[path] == n
    own = {tuple(r["prefix"]): r["cnt"] for r in b.collect()}
    assert [own[p] for p in ((0,), (0, 1), (0, 1, 2), (0, 5), (2,), (2, 3))] == [3, 1, 1, 2, 1, 1]


def test_item_nodes(spark):
    rows = {r["item"]: ([tuple(n) for n in r["nodes"]], r["freq"]) for r in ppc.item_nodes(tree(spark, FIRST)).collect()}
    assert rows[1] == ([(3, 5, 2), (9, 12, 1)], 3)
    assert rows[0][1] == 3 and rows[5][1] == 2


def test_pair_ranks(spark):
    pairs = spark.createDataFrame([(1, 1, 4), (1, 3, 9), (5, 0, 1), (5, 2, 9), (5, 4, 2)], "elem1 int, elem2 int, freq long")
    own = ranks.ranked(pairs, "elem1", "elem2").persist()
    assert ranks.exists_pair(own, 1, 1) and ranks.exists_pair(own, 5, 0)
    assert not ranks.exists_pair(own, 1, 0) and not ranks.exists_pair(own, 5, 3)
    assert ranks.rank_of(own, 1, 3) == 0 and ranks.rank_of(own, 5, 2) == 1 and ranks.rank_of(own, 9, 9) == -1
    assert ranks.pair_of(own, 2) == (1, 1) and ranks.pair_of(own, 5) is None
    assert tuple(ranks.extremes(own).first()) == (5, 4, 5)
    assert {r["elem1"]: r["elems2"] for r in ranks.partners(own).collect()} == {1: [1, 3], 5: [0, 2, 4]}


def test_rank_split(spark):
    shorter = spark.createDataFrame([([1, 2], 0), ([0, 2], 1)], "itemset array<int>, rank int")
    longer = spark.createDataFrame([([0, 1, 2], 0)], "itemset array<int>, rank int")
    assert [tuple(r) for r in ranks.split(longer, shorter).collect()] == [(0, 0, 0)]


def test_result_union(spark):
    def h(rows):
        return spark.createDataFrame(rows, "itemset array<int>, freq long")

    h1, h2, h3 = h([([1, 2], 1), ([2, 3, 4], 1)]), h([([2, 3], 2), ([2, 3, 4], 10)]), h([([2, 3], 7)])
    got = {tuple(r["itemset"]): r["freq"] for r in results.unite(h1, h2, h3).collect()}
    assert got == {(1, 2): 1, (2, 3): 9, (2, 3, 4): 11}
    assert {tuple(r["itemset"]): r["freq"] for r in results.unite(h([]), h2, h3).collect()} == {(2, 3): 9, (2, 3, 4): 10}
    assert results.unite_counts(h1, h2, h3) == 5


def test_orders(spark):
    found = spark.createDataFrame([(["b"], 5), (["a"], 5), (["a", "b"], 5), (["c"], 9), (["a", "c"], 2)], "items array<string>, freq long")
    names = lambda df: ["".join(r["items"]) for r in df.collect()]
    assert names(results.by_size(found)) == ["ab", "ac", "a", "b", "c"]
    assert names(results.by_frequency(found)) == ["c", "ab", "a", "b", "ac"]
    assert names(results.top(found, 2)) == ["c", "a"]
    assert names(results.by_freq(found, ascending=True))[0] == "ac"
    assert results.first(found, 3).count() == 3 and results.of_length(found, 2).count() == 2
    assert results.containing(found, "a", "c").count() == 1
    assert len(results.local(found)) == 5
    assert {r["k"]: r["n"] for r in results.level_counts(found).collect()} == {1: 3, 2: 2}


def test_vertical(spark):
    enc = spark.createDataFrame([(0, [0, 1]), (40_000, [0, 1, 2]), (5, [1, 2]), (7, [])], "tid long, r array<int>")
    frequent = spark.createDataFrame([([0, 1], 2), ([1, 2], 2)], "itemset array<int>, freq long")
    rows = vertical.occurrences(enc, frequent, 2).persist()
    assert {tuple(r["itemset"]): r["tids"] for r in vertical.tid_lists(rows).collect()} == {(0, 1): [0, 40_000], (1, 2): [5, 40_000]}
    bitmaps = vertical.tid_bitmaps(rows)
    assert bitmaps.count() == 4  # two buckets each
    assert {tuple(r["itemset"]): r["freq"] for r in vertical.bitmap_support(vertical.merge_bitmaps(bitmaps.unionByName(bitmaps))).collect()} == {(0, 1): 2, (1, 2): 2}
    assert {tuple(r["itemset"]): (r["size"], r["min"], r["max"]) for r in vertical.describe(rows).collect()} == {(0, 1): (2, 0, 40_000), (1, 2): (2, 5, 40_000)}
    assert {tuple(r["prefix"]): (r["members"], r["freqs"]) for r in vertical.prefix_classes(frequent).collect()} == {(0,): ([1], [2]), (1,): ([2], [2])}
    assert vertical.partitions_for(9, 4) == (4, "4 = min(prefixes=9, processors=4)")
    assert vertical.partitions_for(9, 16, 2)[0] == 2
