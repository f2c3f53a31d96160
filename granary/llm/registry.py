"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from granary.llm import bytebpe, decontaminate, langid, lm, nearest, neardup, repeats, secrets, sharding, tokencount
from granary.llm.shared import docs_of


def queries() -> dict:
    return {
        "op1_secret_scan": lambda spark, d: secrets.scan_in_steps(docs_of(spark, d)),
        "op2_lm_score": lambda spark, d: lm.score(docs_of(spark, d)),
        "op3_language_id": lambda spark, d: langid.identify(docs_of(spark, d)),
        "op4_repeats": lambda spark, d: repeats.digests(docs_of(spark, d)),
        "op5_near_duplicates": lambda spark, d: neardup.near_duplicates(docs_of(spark, d)),
        "op6_decontaminate": lambda spark, d: decontaminate.contaminated(docs_of(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
        "op7_byte_bpe": lambda spark, d: bytebpe.digests(docs_of(spark, d)),
        "op8_sharding": lambda spark, d: sharding.shuffle_rows(docs_of(spark, d)),
        "op9_nearest": lambda spark, d: nearest.search(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op10_token_counts": lambda spark, d: tokencount.counts(docs_of(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.ORACLE_SQL, "op5_near_duplicates": neardup.ORACLE_SQL}
