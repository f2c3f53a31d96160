"""Helpers that several operators use: shared storage, row keys, input names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    A session with all executors in the driver's process may do without; for it
    a folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_granary_root", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
        root = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark._granary_root = root
    return root


class Scratch:
    """Tables written once to the shared folder, so that later stages read
    them instead of recomputing, and a lost executor costs no upstream work.

    Files go when ``drop`` is called, or else when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.path)

    def save(self, df: DataFrame, name: str, append: bool = False) -> DataFrame:
        df.write.mode("append" if append else "error").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        self.fs.delete(jvm(f"{self.root}/{name}" if name else self.root), True)


def text_of(name: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(name: str, df: DataFrame) -> str:
    """The name, longer if the table has it."""
    while name in df.columns:
        name += "_"
    return name


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker turns few texts at a time into
    Python objects however many rows Spark sends at once.  Freed memory goes
    back to the system, as workers outlive their tasks."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch
        pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
