"""The Spark session that the command line and the benchmark use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "", kryo: bool = False, partitions: int | None = None, name: str = "granary", **conf: str) -> SparkSession:
    """A session; an empty master leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.rdd.compress", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if kryo:
        builder = (
            builder.config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
            .config("spark.kryoserializer.buffer", "100m")
            .config("spark.kryoserializer.buffer.max", "256m")
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark
