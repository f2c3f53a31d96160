"""From raw documents to token ids: the corpus pipeline.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; all but the last return the columns of ``documents``.

Defined results: a null, empty or letterless text has no language, so the first
stage drops it; a row without doc_id is an ordinary document, but among near
copies it stays only where none has one; of rows that repeat, one stays; texts of any length are treated whole;
columns that have the stages' own names are kept as they are; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bytebpe, decontaminate, langid, neardup, secrets
from granary.llm.shared import Scratch, docs_of, fresh


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown: no letters, or a calibrated
    score under the rejection score."""
    return langid.keep_accepted(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id in each near-duplicate class."""
    return neardup.drop_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    cut = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, the packed ids and whether they decode to the text; a
    column of ``docs`` with such a name stays, and the result's gets a longer one."""
    give = ("n_tokens", "ids", "round_trip")
    return bytebpe.encode(docs, give=give, names={g: fresh(g, docs) for g in give})


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to shared
    storage and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages train, hash and match; SQL can't express them.
ORACLE_SQL = None
