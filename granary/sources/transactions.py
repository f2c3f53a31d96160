"""Transactions: (tid, items), from text files or from any table."""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relative input names are looked up in the folder that this variable names.
INPUT_PATH = "FIM_INPUT_PATH"


def resolve_input(name: str | None) -> str:
    """A readable path: names with ``://`` are left to Spark, relative ones
    belong to the folder in the environment variable."""
    if not name:
        raise ValueError("Missing mandatory option '--input-file-name'")
    if "://" in name:
        return name
    path = name
    if not os.path.isabs(name):
        root = os.environ.get(INPUT_PATH)
        if root is None:
            raise ValueError(f"Input file name '{name}' is relative and environment variable '{INPUT_PATH}' is not defined")
        path = os.path.join(root, name)
    if not os.access(path, os.R_OK):
        raise ValueError(f"Input file '{name}' does not exist or is not readable")
    return path


def parse_items(line: Column, drop_empty: bool = False) -> Column:
    """A line's distinct items in order.

    Items stand between single spaces; spaces at the end count for nothing, but
    a space at the start or two in a row make an empty item, and an empty line
    is one empty item, while a line of spaces only has none.  Control
    characters and spaces around an item are cut.  A null line has no items.
    """
    ended = F.regexp_replace(line, r" +\z", "")
    trimmed = F.transform(F.split(ended, " "), lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""))
    none = F.array().cast("array<string>")
    items = F.when(line.isNull() | line.rlike(r"^ +\z"), none).when(line == "", F.array(F.lit(""))).otherwise(F.array_sort(F.array_distinct(trimmed)))
    return F.filter(items, lambda x: x != "") if drop_empty else items


def parse_lines(lines: DataFrame, column: str = "value", drop_empty: bool = False) -> DataFrame:
    """(tid, items) from a table with one line per row.  A tid is unique, not
    dense: numbering rows densely would need a pass and a global order."""
    return lines.select(F.monotonically_increasing_id().alias("tid"), parse_items(F.col(column), drop_empty).alias("items"))


def numbered(rows: DataFrame, name: str = "tid") -> DataFrame:
    """``rows`` with numbers from 0 on without gaps, partition by partition: one
    more pass counts the partitions' rows, so they must come from a plan that
    deals them alike each time, as a scan of files does."""
    own = rows.drop(name).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each partition
    placed = own.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def read_text(spark: SparkSession, path: str, parts: int | None = None, drop_empty: bool = False) -> DataFrame:
    """Transactions of a text file, one per line, in ``parts`` partitions at
    least if given."""
    lines = spark.read.text(path)
    if parts and lines.rdd.getNumPartitions() < parts:
        lines = lines.repartition(parts)
    return parse_lines(lines, drop_empty=drop_empty)


def of_arrays(df: DataFrame, tid: str, items: str) -> DataFrame:
    """Transactions of a table with an array column.  Nulls in it and repeats
    are dropped; a null array is an empty transaction, which still counts."""
    clean = F.array_sort(F.array_distinct(F.array_compact(F.col(items).cast("array<string>"))))
    return df.select(F.col(tid).alias("tid"), F.coalesce(clean, F.array().cast("array<string>")).alias("items"))


def of_pairs(df: DataFrame, tid: str, item: str) -> DataFrame:
    """Transactions of a table with one row per item."""
    return df.groupBy(F.col(tid).alias("tid")).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))


def persisted(transactions: DataFrame, wanted: bool = True) -> DataFrame:
    return transactions.persist(StorageLevel.MEMORY_ONLY) if wanted else transactions
