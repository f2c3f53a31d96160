import pytest
from pyspark.sql import functions as F

from granary.operators import encode, support
from granary.sources import transactions as T


@pytest.mark.parametrize(
    "line, items",
    [("", [""]), ("  ", []), ("a  b ", ["", "a", "b"]), (" 5 ", ["", "5"]), ("a \t", ["", "a"]), ("3 1 2 1", ["1", "2", "3"]), (None, []), ("x\n y\n", ["x", "y"]), ("é z", ["z", "é"])],
)
def test_parse(spark, line, items):
    rows = spark.createDataFrame([(line,)], "value string")
    assert T.parse_lines(rows).first()["items"] == items
    assert T.parse_lines(rows, drop_empty=True).first()["items"] == [i for i in items if i]


def test_read_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 2 3\n\n2 2 1\n")
    rows = T.read_text(spark, str(tmp_path / "t.txt"), 3).collect()
    assert sorted(r["items"] for r in rows) == [[""], ["1", "2"], ["1", "2", "3"]]
    assert len({r["tid"] for r in rows}) == 3


def test_of_arrays(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, None), (3, [])], "t long, x array<string>")
    got = {r["tid"]: r["items"] for r in T.persisted(T.of_arrays(rows, "t", "x"), False).collect()}
    assert got == {1: ["a", "b"], 2: [], 3: []}


def test_resolve_input(tmp_path, monkeypatch):
    path = tmp_path / "in.txt"
    path.write_text("a")
    assert T.resolve_input("s3://bucket/x") == "s3://bucket/x"
    assert T.resolve_input(str(path)) == str(path)
    monkeypatch.delenv(T.INPUT_PATH, raising=False)
    with pytest.raises(ValueError, match="is not defined"):
        T.resolve_input("in.txt")
    monkeypatch.setenv(T.INPUT_PATH, str(tmp_path))
    assert T.resolve_input("in.txt") == str(path)
    with pytest.raises(ValueError, match="not readable"):
        T.resolve_input("none.txt")
    with pytest.raises(ValueError):
        T.resolve_input(None)


def test_min_support():
    assert support.min_support_count(100, 0.07) == 8
    assert support.min_support_count(14743, 0.1) == 1475
    assert support.min_support_count(10, 1) == 10
    for bad in (0, -0.1, 1.01):
        with pytest.raises(ValueError):
            support.min_support_count(10, bad)


@pytest.mark.parametrize("inline", [0, 256])
def test_encoding(spark, monkeypatch, inline):
    monkeypatch.setattr(encode, "INLINE", inline)
    rows = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "c"]), (3, ["b", "a", None]), (4, []), (5, ["z"])], "tid long, items array<string>")
    own = encode.Encoding(rows, 2)
    assert (own.items, own.freqs, len(own)) == (["b", "a"], [3, 2], 2)
    got = {r["tid"]: r["r"] for r in own.encoded().collect()}
    assert got == {1: [0, 1], 2: [0], 3: [0, 1], 4: [], 5: []}
    assert {tuple(r["r"]): r["w"] for r in own.patterns().collect()} == {(0, 1): 2, (0,): 1}
    named = own.decode(spark.createDataFrame([([0, 1], 2), ([1], 2)], "itemset array<int>, freq long"))
    assert {tuple(r["items"]): r["freq"] for r in named.collect()} == {("a", "b"): 2, ("a",): 2}
    assert [(r["item"], r["rank"]) for r in encode.dictionary(encode.item_counts(rows, 1)).orderBy("rank").collect()] == [("b", 0), ("a", 1), ("c", 2), ("z", 3)]
