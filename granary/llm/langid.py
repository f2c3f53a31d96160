"""Language identification with averaged hashed subword embeddings.

Subwords are byte windows of 2 to 4 inside words (with their edges), hashed to
BUCKETS.  A text's vector is the mean of its subwords' embeddings; a linear
softmax gives the languages.  Embeddings and weights are trained together by
stochastic gradient descent in numpy on a bounded sample: about FIT_ROWS
labelled texts, in equal parts by language (one text of each at least), chosen
by a hash of doc_id and text; rows equal in both are learned once.

One more class stands for what is none of the languages.  Its examples are made
from a quarter of the sample: the letters of a text shuffled, or replaced by
letters of another script.  Part of the sample is left out of the training: on
it a temperature is fitted, so that scores are calibrated, and the chance of
"none" over which a text is rejected, such that at most a share LOST of its
rightly classified texts would be, with MARGIN to spare; it is LEAST at least, so
that short or odd texts stay.

For prediction, embedding and softmax weights fold into one table of BUCKETS x
classes where that is the smaller one, so each subword costs one lookup.
Prediction is a narrow map.

Defined results: a text that is null or has no letter gives ``und``, score 0,
rejected; null labels are not learned; a null doc_id counts as not held out;
without any labelled row all is ``und``; repeated rows repeat; other columns
are kept by ``predict``, whose results can be named otherwise; empty in, empty
out.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import fresh, parts

BUCKETS, DIM, FIT_ROWS = 1 << 16, 16, 4000
EPOCHS, RATE, SEED = 8, 1.0, 11
#: How far a step moves a text's mean embedding, against the softmax weights.
NUDGE = 0.1
#: Share of right calibration texts that rejection may lose, how far the limit lies beyond, in logits, and the least limit.
LOST, MARGIN, LEAST = 0.001, 2.0, 0.95
#: First letters of scripts in which examples of no language are written, and how many letters are used of each.
SCRIPTS, LETTERS = (0x0391, 0x0430, 0x05D0, 0x0627, 0x0905, 0x0E01, 0x10D0, 0x3041, 0x4E00, 0xAC00), 24

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)


def windows(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width: the bucket of each window and whether it counts."""
    space = raw == 0x20
    wide = raw.astype(np.uint32)
    packed = wide
    for n in (2, 3, 4):
        packed = (packed[:-1] << 8) | wide[n - 1 :]
        m = len(packed)
        counts = ~(space[:m] & space[n - 1 : n - 1 + m]) if n == 2 else ~space[1 : 1 + m]
        for k in range(2, n - 1):
            counts &= ~space[k : k + m]
        yield ((packed * np.uint32(2_654_435_761) + np.uint32(n * 40_503)) >> np.uint32(16)) & np.uint32(BUCKETS - 1), counts


def cleaned(text: str) -> np.ndarray:
    return _LETTERS[np.frombuffer(b" " + text.lower().encode() + b"   ", dtype=np.uint8)]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which add up to 1."""
    found = np.concatenate([b[c] for b, c in windows(cleaned(text))])
    ids, n = np.unique(found, return_counts=True)
    return ids.astype("<u4"), (n / max(1, len(found))).astype("<f4")


def noise(text: str, draw: int) -> str:
    """A text of no language: its letters shuffled, or of another script."""
    rng = random.Random(draw)
    letters = [c for c in text.lower() if c.isalpha()]
    if draw % 2:
        rng.shuffle(letters)
    else:
        first = SCRIPTS[draw // 2 % len(SCRIPTS)]
        letters = [chr(first + ((ord(c) + draw) * 2_654_435_761 >> 7) % LETTERS) for c in letters]
    turn = iter(letters)
    return "".join(next(turn) if c.isalpha() else c for c in text.lower())


class Model:
    """``table`` has a row for each bucket: its embedding, or the classes'
    shares if ``out`` is None.  The last class is that of no language."""

    def __init__(self, langs: list[str], table: np.ndarray, out: np.ndarray | None, bias: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.out, self.bias, self.temperature, self.reject = langs, table, out, bias, temperature, reject

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row per text, over the concatenated bytes of all."""
        if not texts:
            return np.zeros((0, len(self.bias)))
        parts = [cleaned(t) for t in texts]
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        raw = np.concatenate(parts)
        total, n = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for buckets, counts in windows(raw):
            counts[starts[1:] - 1] = False  # from a text's last byte into the next text
            values = self.table[buckets]
            values[~counts] = 0
            total += np.add.reduceat(values, starts, axis=0)
            n += np.add.reduceat(counts, starts, dtype=np.int64)
        mean = total / np.maximum(n, 1)[:, None]
        return (mean if self.out is None else mean @ self.out) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str]) -> Model:
    """Of bags of subwords with the numbers of their classes; len(langs) is none."""
    rng, classes = np.random.default_rng(SEED), len(langs) + 1
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    fold = rng.random(len(bags)) < 0.2
    fit, held = np.flatnonzero(~fold), np.flatnonzero(fold)
    if not len(fit):
        fit = held
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, share = bags[i]
            if not len(ids):
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            h = share @ emb[ids]
            z = h @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[labels[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= rate * g
            # a mean over many subwords spreads the step thin; it is scaled so that the text's vector moves by NUDGE x rate
            emb[ids] -= (rate * NUDGE / float(share @ share) * share)[:, None] * back
    model = Model(langs, *((emb @ out, None) if classes <= DIM else (emb, out)), bias, 1.0, 1.0)
    held = held if len(held) else fit
    z = np.stack([share @ emb[ids] @ out + bias for ids, share in (bags[i] for i in held)])
    y = labels[held]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = (p[:, :-1].argmax(axis=1) == y) & (y < len(langs))
    if right.any():
        none = p[right, -1].clip(1e-9, 1 - 1e-9)
        limit = np.quantile(np.log(none / (1 - none)), 1 - LOST, method="higher") + MARGIN
        model.reject = float(max(LEAST, 1 / (1 + np.exp(-limit))))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """The model of the labelled rows that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(1, np.float32), 1.0, 1.0)
    whole, each = 1 << 30, max(1, FIT_ROWS // len(langs))
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, min(whole, whole * each // counts[k]))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(whole))
    chosen = rows.where(draw <= limit[F.col("lang")]).select(draw.alias("draw"), "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = []
            for draw, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                found.append((draw, lang, *bag(text)))
                if draw % 4 == 0 and has_letter(text):
                    found.append((draw, None, *bag(noise(text, draw // 4))))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in columns[2:]]],
                names=["draw", "lang", "ids", "share"],
            )

    # Some FIT_ROWS different rows of at most BUCKETS entries, and a quarter of them once more.
    drawn = chosen.mapInArrow(run, "draw long, lang string, ids binary, share binary")
    sample = drawn.groupBy("draw", "lang").agg(F.min(F.struct("ids", "share")).alias("bag")).select("draw", "lang", "bag.*").collect()
    sample.sort(key=lambda r: (r["draw"], r["lang"] is None, r["lang"] or ""))
    bags = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["share"], "<f4")) for r in sample]
    place = {None: len(langs)} | {k: i for i, k in enumerate(langs)}
    return train(bags, np.array([place[r["lang"]] for r in sample]), langs)


NEW = ("lang_pred", "score", "accepted")


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = NEW) -> DataFrame:
    """``docs`` with the predicted language, its score and whether the text is
    accepted, under the given names."""
    kept = docs.drop(*[n for n in names if n in docs.columns])
    at = kept.columns.index("text")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers, and as many for each language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in parts(batches):
            texts = batch.column(at).to_pylist()
            langs, scores, fine = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for some in slices(texts):
                known = [i for i in some if own.langs and has_letter(texts[i])]
                p = own.scores([texts[i] for i in known])
                for i, row in zip(known, p):
                    k = int(row[:-1].argmax())
                    langs[i], scores[i], fine[i] = own.langs[k], float(row[k]), bool(row[-1] <= own.reject)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(scores), pa.array(fine)], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def slices(texts: list[str | None], most: int = 1 << 18) -> Iterator[list[int]]:
    """Row numbers, some ``most`` characters at a time."""
    some: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def identify(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and predict each of its rows."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known; columns stay."""
    names = tuple(fresh(n, docs) for n in NEW)
    return predict(docs, fit(docs), names).where(F.col(names[2])).select(*docs.columns)
