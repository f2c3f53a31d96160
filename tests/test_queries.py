"""All queries of the mining library against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from granary.plans import registry
from granary.streaming.remine import remine

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    got, want = registry.QUERIES[name](spark, str(DATA)).toPandas(), db.sql(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(df):
        return sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))

    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["itemset", "k", "freq"] and found.count() == 1601
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_remine(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "tid long, items array<string>").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("tid long, items array<string>").parquet(f"{tmp_path}/in")
    for _ in range(2):
        remine(stream, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/cp", 0.5, "FIN").awaitTermination()
        spark.createDataFrame([(3, ["a", "b"])], "tid long, items array<string>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda n: {tuple(r["items"]): r["freq"] for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect()}
    assert read(0) == {("a",): 2, ("b",): 1, ("a", "b"): 1}
    assert read(1) == {("a",): 3, ("b",): 2, ("a", "b"): 2}
