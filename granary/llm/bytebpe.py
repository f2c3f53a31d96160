"""Byte-level BPE encoding and decoding with the tokenizers library.

Encoding runs over Arrow batches; ids are packed little-endian unsigned 32-bit
integers.  Byte starts of tokens follow from the ids, and a byte-to-character
map gives their character starts, so tokens that begin inside a character are
known.  Decoding reverses the printable-byte table of the vocabulary and joins
bytes before any UTF-8 decoding, so characters split over tokens come back
whole; a cut token range keeps its own bytes and shows broken characters as
U+FFFD only in text form.

Special-token strings in a text are ordinary text.  Defined results: a null
text counts as empty (no ids); rows are independent, so repeated rows repeat;
other columns of the input are kept by ``encode`` unless they bear the name of
one of its results, which replaces them; an empty table gives an empty one.
No shuffle; memory is bounded by CHUNK bytes of text at a time, or one text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.shared import parts

#: Bytes of text that are encoded at a time.
CHUNK = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_table() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: a byte that prints stands for
    itself, the others take the code points from 256 on, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


#: Characters whose class is as PIECES takes it; other texts go whole through
#: the library.
PLAIN = re.compile("[\x00-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
_SPACE = "\t-\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The split before merging, with its classes spelt out for those characters.
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
SPACED = re.compile(f" [{_LETTER}]+")
#: Words in a row that the library gets as one text.
IN_A_ROW = 500
#: Pieces in each of the cache's two generations, and the longest kept.
CACHED, LONGEST = 100_000, 64


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        table = byte_table()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(table[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of pieces.  Words that begin with a space stay apart when
        they stand in a row, so many go through the library as one text; its
        tokens' sizes show where each ends."""
        spaced = [p for p in pieces if SPACED.fullmatch(p)]
        rest = [p for p in pieces if not SPACED.fullmatch(p)]
        out = dict(zip(rest, self.library(rest)))
        rows = [spaced[a : a + IN_A_ROW] for a in range(0, len(spaced), IN_A_ROW)]
        for row, ids in zip(rows, self.library(["".join(r) for r in rows])):
            ends = np.cumsum(self.sizes[np.frombuffer(ids, dtype="<u4")])
            cuts = 4 * (np.searchsorted(ends, np.cumsum([len(p.encode()) for p in row])) + 1)
            at = 0
            for p, cut in zip(row, cuts.tolist()):
                out[p] = ids[at:cut]
                at = cut
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text.  Pieces don't touch each other, so the
        library sees each piece once and a cache has it from then on."""
        split = [PIECES.findall(t) if PLAIN.fullmatch(t) else None for t in texts]
        missing = {p for pieces in split if pieces is not None for p in pieces} - self.young.keys()
        found = {p: self.old[p] for p in missing & self.old.keys()}
        new = list(missing - found.keys())
        found.update(self.pieces(new))
        self.young.update(found)
        get = self.young.__getitem__
        out = [self.library([t])[0] if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, split)]
        for p in found:
            if len(p) > LONGEST:
                del self.young[p]
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        return out

    def starts(self, texts: list[str], ids: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text the characters in which its tokens begin; and how
        many of its tokens begin inside a character."""
        raws = [t.encode() for t in texts]
        first = (np.frombuffer(b"".join(raws), dtype=np.uint8) & 0xC0) != 0x80
        character = np.cumsum(first) - 1
        all_ids = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = self.sizes[all_ids]
        at = np.cumsum(sizes) - sizes
        inside = np.concatenate(([0], np.cumsum(~first[at])))
        ends = np.cumsum([len(i) // 4 for i in ids])
        begins = np.concatenate(([0], ends[:-1]))
        base = np.cumsum([0, *map(len, texts[:-1])])
        where = (character[at] - np.repeat(base, ends - begins)).astype("<u4")
        return [where[a:b] for a, b in zip(begins.tolist(), ends.tolist())], inside[ends] - inside[begins]

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: What encoding can give, with its types.
RESULTS = {"n_tokens": "long", "ids": "binary", "char_starts": "binary", "n_split": "long", "decoded": "binary", "round_trip": "boolean", "ids_sha256": "string", "decoded_sha256": "string"}


def results(own: "Codec", texts: list[str], give: tuple[str, ...]) -> list[pa.Array]:
    """The columns named in ``give`` for some texts; nothing else is made."""
    ids = own.encode(texts)
    wanted, made = set(give), {"ids": ids}
    if "n_tokens" in wanted:
        made["n_tokens"] = [len(i) // 4 for i in ids]
    if wanted & {"char_starts", "n_split"}:
        starts, made["n_split"] = own.starts(texts, ids)
        made["char_starts"] = [s.tobytes() for s in starts]
    if wanted & {"decoded", "round_trip", "decoded_sha256"}:
        back = made["decoded"] = [own.decode(np.frombuffer(i, dtype="<u4")) for i in ids]
        made["round_trip"] = [d == t.encode() for d, t in zip(back, texts)]
        made["decoded_sha256"] = [sha256(d).hexdigest() for d in back]
    if "ids_sha256" in wanted:
        made["ids_sha256"] = [sha256(i).hexdigest() for i in ids]
    return [pa.array(made[g], TYPES[RESULTS[g]]) for g in give]


TYPES = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def encode(
    docs: DataFrame, path: str | None = None, text: str = "text", give: tuple[str, ...] = ("n_tokens", "ids", "char_starts", "n_split"), names: dict[str, str] | None = None
) -> DataFrame:
    """``docs`` with the results named in ``give``: n_tokens, ids, char_starts
    (packed alike), n_split (tokens that begin inside a character), decoded (the
    ids' bytes, made in the same pass), round_trip (whether those are the
    text's) and digests of ids and decoded bytes.  ``names`` gives results other
    column names."""
    path = path or default_vocabulary()
    named = [(names or {}).get(g, g) for g in give]
    kept = docs.drop(*[n for n in named if n in docs.columns and n != text])
    at = kept.columns.index(text)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    new = ", ".join(f"`{n}` {RESULTS[g]}" for n, g in zip(named, give))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *results(own, texts[a:b], give)], names=[*batch.schema.names, *named])

    return kept.mapInArrow(run, f"{fields}, {new}")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in column ``to``, and without the
    packed columns; null ids give null."""
    path = path or default_vocabulary()
    kept = encoded.drop(*[n for n in (to,) if n in encoded.columns])
    at = kept.columns.index(ids)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in parts(batches):
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                packed = part.column(at).to_pylist()
                out = [None if p is None else own.decode(np.frombuffer(p, dtype="<u4")) for p in packed]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, to])

    return kept.mapInArrow(run, f"{fields}, {to} binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The round trip's digests for each document, made in the worker, so
    neither texts nor ids go back to the JVM."""
    path = path or default_vocabulary()
    give = ("n_tokens", "ids_sha256", "decoded_sha256", "n_split")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *results(own, texts[a:b], give)], names=["doc_id", *give])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{g} {RESULTS[g]}" for g in give))
