"""Mining again as transactions arrive: each micro-batch is appended to a
table, and the whole table is mined."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from granary.plans import miners


def remine(stream: DataFrame, store: str, out: str, checkpoint: str, min_supp: float, miner: str = "BIG_FIM", **options: Any) -> StreamingQuery:
    """Start a query over a stream of (tid, items): ``store`` gets the
    transactions, a folder for each batch, and ``out`` the itemsets of all up
    to that batch.  A batch that is run again replaces its own folders."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("tid", "items").write.mode("overwrite").parquet(f"{store}/batch={number}")
        found = miners.mine(spark.read.parquet(store).where(f"batch <= {number}").select("tid", "items"), min_supp, miner, **options)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
