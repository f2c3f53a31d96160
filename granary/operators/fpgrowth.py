"""FP-Growth as Spark ML has it."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fp_growth(transactions: DataFrame, min_supp: float, parts: int | None = None) -> DataFrame:
    """(items, freq).  Repeats in a transaction count once and null ones count
    as empty, which the estimator leaves to its caller."""
    clean = F.coalesce(F.array_distinct(F.array_compact("items")), F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=float(min_supp), **({"numPartitions": parts} if parts else {})).fit(transactions.select(clean.alias("items")))
    return model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
