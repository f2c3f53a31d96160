import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_table(spark):
    def make(rows, extra=""):
        """Rows of (doc_id, text, lang) or (doc_id, text)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    def make(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make


#: Texts that any operator must bear.
EDGES = [(1, None), (None, "some text here"), (2, ""), (2, ""), (3, " \t\n "), (4, "é" * 7 + "中文字 \U0001f600"), (None, None), (5, "word " * 20_000), (6, "x" * 60_000), (7, "\x00\x01 nul")]


@pytest.fixture(scope="session")
def edges(spark, docs_table):
    return docs_table(EDGES)


@pytest.fixture(scope="session")
def clashing(spark, docs_table):
    """A table with columns named like operators' own."""
    from pyspark.sql import functions as F

    df = docs_table([(1, "token = abcdefgh1 and more words in it"), (2, "plain words only, nothing else at all")])
    for c in ("matches", "score", "lang_pred", "accepted", "ids", "n_tokens", "node", "shard", "blob", "_found", "class_id", "key", "row", "bands", "decoded", "n_split", "char_starts"):
        df = df.withColumn(c, F.lit("own"))
    return df
