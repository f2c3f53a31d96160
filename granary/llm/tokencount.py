"""Token counts by a two-tier lookup of pre-token lengths.

A text's token count is the sum over its pre-tokens.  The first tier is a
compact broadcast table with the lengths of frequent pre-tokens; what it lacks
is encoded by the library, a batch of distinct misses at a time, and kept in a
worker's cache of bounded size.  No pre-token is shuffled: to find the
frequent ones, each task sends one summary of at most SUMMARY entries.

The split into pre-tokens is done here only for texts whose characters are all
in a range where its rules are plain; every other text, and every text with a
special-token string, goes whole through the library.

Defined results: a null text counts as empty; rows are independent, so
repeated rows repeat; null doc_ids stay; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import parts

#: Entries of the broadcast table; of a task's summary; of a worker's cache;
#: distinct pre-tokens that a task counts before it drops the rarest.
FREQUENT, SUMMARY, CACHED, COUNTED = 32_768, 8_192, 400_000, 300_000
#: A pre-token longer than this is not kept in tables.
LONGEST = 64

_SPACE = "\t-\r \x85\xa0"
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-ſ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Lower-cased text to pre-tokens.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
#: Characters whose normal form, case and class are as SPLIT takes them.
PLAIN = re.compile("[\x00-įı-ſ‐-‧‰-⁞€]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Library:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens, or None if the text must go whole."""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return None
        return SPLIT.findall(text.lower())


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def frequent(docs: DataFrame, path: str) -> DataFrame:
    """The most frequent pre-tokens of all texts, from bounded summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = library(path), Counter()
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                seen.update(own.split(text or "") or ())
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [x for x in seen.most_common(SUMMARY) if len(x[0]) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT)


def counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    path = path or default_vocabulary()
    words = [r[0] for r in frequent(docs, path).collect()]  # at most FREQUENT short strings
    sizes = np.array(library(path).lengths(words), dtype=np.uint8)  # LONGEST characters give under 256 tokens
    table = docs.sparkSession.sparkContext.broadcast(("\n".join(words).encode(), sizes.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(path)
        first = dict(zip(table.value[0].decode().split("\n"), table.value[1]))
        cache = dict(first)
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for a in range(0, len(texts), 256):
                out += totals(own, texts[a : a + 256], cache)
                if len(cache) > CACHED:
                    cache = dict(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(out, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def totals(own: Library, texts: list[str], cache: dict[str, int]) -> list[int]:
    """Token counts of some texts; fills the cache with what it lacked."""
    out, late, missed = [0] * len(texts), [], set()
    get = cache.get
    for i, text in enumerate(texts):
        pieces = own.split(text)
        if pieces is None:
            out[i] = own.lengths([text])[0]
            continue
        found = list(map(get, pieces))
        if None in found:
            lacks = Counter(p for p, n in zip(pieces, found) if n is None)
            missed.update(lacks)
            late.append((i, lacks))
            found = [n for n in found if n is not None]
        out[i] = sum(found)
    todo = list(missed)
    now = dict(zip(todo, own.lengths(todo)))
    for i, lacks in late:
        out[i] += sum(now[p] * n for p, n in lacks.items())
    cache.update((p, n) for p, n in now.items() if len(p) <= LONGEST)
    return out
