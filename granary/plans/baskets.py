"""Baskets built from the warehouse tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.transactions import of_pairs

#: Name to (min-supp, DuckDB SQL of its distinct (tid, item) rows).
SQL = {
    "order_attr": (
        0.1,
        "select distinct l_orderkey as tid, unnest(['rf=' || l_returnflag, 'ls=' || l_linestatus, 'pt=' || p_type, 'op=' || o_orderpriority, 'os=' || o_orderstatus]) as item"
        " from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
    ),
    "cust_brand": (
        0.5,
        "select distinct o_custkey as tid, p_brand as item from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
    ),
    "user_event": (0.9, "select distinct user_id as tid, event_type as item from events"),
    "order_kind": (
        0.002,
        "select distinct l_orderkey as tid, unnest([p_brand || '/' || p_size, 'rf=' || l_returnflag]) as item from lineitem join part on l_partkey = p_partkey",
    ),
    "order_brand": (0.002, "select distinct l_orderkey as tid, p_brand as item from lineitem join part on l_partkey = p_partkey"),
}


def supports(name: str) -> float:
    return SQL[name][0]


def baskets(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(tid, items)."""

    def table(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    if name == "user_event":
        return of_pairs(table("events"), "user_id", "event_type")
    part = table("part").select("p_partkey", "p_brand", "p_type", "p_size")
    lines = table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    if name == "order_brand":
        return of_pairs(lines, "l_orderkey", "p_brand")
    if name == "order_kind":  # many different items
        items = F.array(F.concat("p_brand", F.lit("/"), "p_size"), F.concat(F.lit("rf="), "l_returnflag"))
        return of_pairs(lines.select("l_orderkey", F.explode(items).alias("item")), "l_orderkey", "item")
    rows = lines.join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if name == "cust_brand":
        return of_pairs(rows, "o_custkey", "p_brand")
    marks = {"rf=": "l_returnflag", "ls=": "l_linestatus", "pt=": "p_type", "op=": "o_orderpriority", "os=": "o_orderstatus"}
    items = F.array(*[F.concat(F.lit(k), F.col(c)) for k, c in marks.items()])
    return of_pairs(rows.select("l_orderkey", F.explode(items).alias("item")), "l_orderkey", "item")
