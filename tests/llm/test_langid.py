import random

import numpy as np

from granary.llm import langid

SYLLABLES = {"aa": "ka to mi ra su".split(), "bb": "sch ein und ber acht".split(), "cc": "ño ción ll ez ue".split()}


def text(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(n=240):
    return [(i, text(list(SYLLABLES)[i % 3], i), list(SYLLABLES)[i % 3]) for i in range(n)]


def test_held_out_accuracy(docs_table):
    table = docs_table(rows() + [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (None, text("bb", 5), None), (1003, "x" * 50_000, None)])
    got = langid.identify(table).collect()
    want = {i: k for i, _, k in rows()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert len(held) > 20 and sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"], by[i]["accepted"]) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert by[None]["lang_pred"] == "bb" and not by[None]["held_out"]
    assert sum(r["accepted"] for r in got if r["doc_id"] in want) >= 0.99 * len(want)


def test_rejects_texts_of_no_language(docs_table):
    model = langid.fit(docs_table(rows()))
    clean = [text(k, 5000 + i, n) for i, k in enumerate([*SYLLABLES] * 20) for n in (6, 40)]
    other = ["".join(chr(0x0430 + (i * j * 7 + j) % 30) if j % 6 else " " for j in range(1, 200)) for i in range(1, 40)]
    shuffled = [langid.noise(t, 2 * i + 1) for i, t in enumerate(clean) if len(t) > 100]
    none = lambda texts: [row[-1] > model.reject for row in model.scores(texts)]
    assert langid.LEAST <= model.reject < 1
    assert sum(none(clean)) <= 0.01 * len(clean)
    assert sum(none(other)) >= 0.9 * len(other) and sum(none(shuffled)) >= 0.9 * len(shuffled)


def test_logits_against_plain_bags():
    rng = random.Random(3)
    model = langid.Model(["x", "y"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32), None, np.array([0.1, -0.2, 0.3]), 1.0, 0.9)
    texts = ["".join(rng.choice("ab cédE 1中 ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "a", " "]
    for t, row in zip(texts, model.logits(texts)):
        raw = bytes(langid.cleaned(t)).decode("latin-1")
        found = []
        for n in (2, 3, 4):
            for i in range(len(raw) - n + 1):
                w = raw[i : i + n]
                if (w.strip(" ") if n == 2 else " " not in w[1 : n - 1] and w[1]):
                    number = 0
                    for c in w:
                        number = (number << 8 | ord(c)) & 0xFFFFFFFF
                    found.append(((number * 2_654_435_761 + n * 40_503) % (1 << 32) >> 16) % langid.BUCKETS)
        want = model.table[found].astype(float).sum(axis=0) / max(1, len(found)) + model.bias if found else model.bias
        assert np.allclose(row, want, atol=1e-4), t


def test_many_languages_and_repeated_rows(docs_table):
    """More languages than DIM; rows without doc_id, and one row many times."""
    names = [f"l{i:02d}" for i in range(langid.DIM + 4)]
    letters = {n: "".join(random.Random(n).sample("abcdefghijklmnopqrstuvwxyz", 5)) for n in names}
    make = lambda n, i: " ".join("".join(random.Random(f"{n}{i}{j}").choices(letters[n], k=6)) for j in range(30))
    table = docs_table([(None, make(n, i), n) for n in names for i in range(30)] + [(7, make("l00", 1), "l00")] * 500)
    model = langid.fit(table)
    assert model.langs == names and model.out is not None
    fresh = [(n, make(n, 1000 + i)) for n in names for i in range(5)]
    p = model.scores([t for _, t in fresh])
    assert sum(model.langs[int(r[:-1].argmax())] == n for r, (n, _) in zip(p, fresh)) >= 0.9 * len(fresh)


def test_labels_are_no_inputs(docs_table):
    table = docs_table(rows(60))
    model = langid.fit(table)
    swapped = docs_table([(i + 7, t, "zz") for i, t, _ in rows(60)])
    a = [r["lang_pred"] for r in langid.predict(table, model).orderBy("doc_id").collect()]
    assert a == [r["lang_pred"] for r in langid.predict(swapped, model).orderBy("doc_id").collect()]


def test_no_labels_and_empty(docs_table):
    got = langid.identify(docs_table([(1, "abc", None), (1, "abc", None)])).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und"]
    assert langid.identify(docs_table([])).count() == 0


def test_keep_accepted_keeps_columns(clashing):
    kept = langid.keep_accepted(clashing)
    assert kept.columns == clashing.columns and kept.count() == 2
    both = clashing.withColumn("_own_score", clashing["score"]).withColumn("score_", clashing["score"])
    assert langid.keep_accepted(both).columns == both.columns and langid.keep_accepted(both).count() == 2
    assert set(kept.first().asDict()[c] for c in ("score", "lang_pred", "accepted")) == {"own"}
