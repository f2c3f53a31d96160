import pytest
from pyspark.sql import functions as F

from granary.functions import bitsets as B
from granary.functions import patterns, subsets

BITS = [0, 1, 7, 63, 64, 65, 128, 192, 200, 213, 214, 1034, 1234]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def built(bits, size=1300, start=3):
    return B.set_all(B.empty(size, start), F.array(*[F.lit(b).cast("long") for b in bits]), start)


def test_bitset_reads(spark):
    w = built(BITS)
    row = spark.range(1).select(w.alias("w")).select(
        B.cardinality(F.col("w"), 3).alias("n"), B.lowest(F.col("w"), 3).alias("lo"), B.highest(F.col("w"), 3).alias("hi"),
        B.as_numbers(F.col("w"), 3).alias("all"), B.word_numbers(F.col("w"), 3, 3).alias("w0"), B.word_numbers(F.col("w"), 4, 3).alias("w1"),
        *[B.get(F.col("w"), F.lit(b), 3).alias(f"b{b}") for b in (2, 8, 100, 63, 1234)], B.is_zero(F.col("w"), 3).alias("z"),
    ).first()
    assert (row["n"], row["lo"], row["hi"], row["all"]) == (13, 0, 1234, BITS)
    assert row["w0"] == [0, 1, 7, 63] and row["w1"] == [64, 65]
    assert [row[f"b{b}"] for b in (2, 8, 100, 63, 1234)] == [False, False, False, True, True]
    assert not row["z"]


def test_bitset_empty(spark):
    row = spark.range(1).select(B.lowest(B.empty(70)).alias("lo"), B.highest(B.empty(70)).alias("hi"), B.is_zero(B.empty(70)).alias("z"), B.as_numbers(B.empty(0)).alias("none")).first()
    assert (row["lo"], row["hi"], row["z"], row["none"]) == (-1, -1, True, [])


def test_sizes(spark):
    assert (B.words_for(64), B.words_for(65), B.words_for(65, 3), B.word_index(64, 3)) == (1, 2, 5, 4)
    assert [one(spark, B.word_start(F.lit(b))) for b in (0, 1, 63, 64, 65, 127, 128)] == [0, 0, 0, 64, 64, 64, 128]


@pytest.mark.parametrize("last", [63, 127, 128, 1233, 1234, 1235])
def test_flip(spark, last):
    got = one(spark, B.as_numbers(B.flip(built(BITS), last, 3), 3))
    assert got == [b for b in range(1344) if (b not in BITS if b <= last else b in BITS)]


def test_set_operations(spark):
    a, b = [1, 5, 63, 64, 130], [5, 64, 65]
    x, y = built(a, 192, 0), built(b, 192, 0)
    assert one(spark, B.as_numbers(B.both(x, y))) == [5, 64]
    assert one(spark, B.as_numbers(B.either(x, y))) == [1, 5, 63, 64, 65, 130]
    assert one(spark, B.as_numbers(B.minus(x, y))) == [1, 63, 130]
    assert one(spark, B.as_numbers(B.same(x, y))) == [i for i in range(192) if (i in a) == (i in b)]


@pytest.mark.parametrize("n", range(11))
def test_number_of_subsets(spark, n):
    rows = spark.createDataFrame([(list(range(n)),)], "items array<int>")
    found = [tuple(r["subset"]) for r in subsets.subsets(rows, "items").collect()]
    assert len(found) == len(set(found)) == 2**n == subsets.number_of_subsets(n)


def test_subsets_of_a_size(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4],)], "items array<int>")
    assert {tuple(r["subset"]) for r in subsets.subsets(rows, "items", 2).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert subsets.subsets(rows, "items", 5).count() == 0
    with pytest.raises(ValueError):
        subsets.subsets(rows, "items", -1)
    with pytest.raises(ValueError):
        subsets.number_of_subsets(63)


def test_expand(spark):
    closed = spark.createDataFrame([([3], [1, 2], 7), ([5, 4], [4], 2), ([9], [], 1)], "base array<int>, equiv array<int>, freq long")
    got = {tuple(r["itemset"]): r["freq"] for r in subsets.expand(closed).collect()}
    assert got == {(3,): 7, (1, 3): 7, (2, 3): 7, (1, 2, 3): 7, (4, 5): 2, (9,): 1}
    assert closed.agg(subsets.expanded_count()).first()[0] == 6
    assert closed.limit(0).agg(subsets.expanded_count()).first()[0] == 0


def test_patterns(spark):
    row = spark.createDataFrame([(["b", "a"], ["b", "c"], 4, [1, 0])], "x array<string>, y array<string>, n long, r array<int>").select(
        patterns.contains_items(F.col("x"), "a").alias("has"), patterns.contains_items(F.col("x"), "a", "z").alias("no"),
        patterns.starts_with(F.col("x"), F.array(F.lit("b"))).alias("starts"), patterns.common_prefix(F.col("x"), F.col("y"), 1).alias("one"),
        patterns.common_prefix(F.col("x"), F.col("y"), 2).alias("two"), patterns.text(F.col("x"), F.col("n")).alias("text"),
        patterns.text_with_ranks(F.col("x"), F.col("r"), F.col("n"), 2).alias("long"),
    ).first()
    assert (row["has"], row["no"], row["starts"], row["one"], row["two"]) == (True, False, True, True, False)
    assert row["text"] == "FI: [a, b]: 4"
    assert row["long"] == f"{'[b, a]':<11} {'[1, 0]':<9} {'[0, 1]':<9}: 4"
