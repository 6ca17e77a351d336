"""Language identification: held-out accuracy, scores against a plain kernel ridge regression, edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import language_id, queries

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    found = queries.op11_language_id(spark, BIG).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(langs) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.99


def test_only_texts_of_learned_rows_matter(spark, make):
    """Other labels on held-out rows, other ids and sources change no prediction."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").limit(200)
    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    renamed = learned.withColumns({"doc_id": -F.col("doc_id"), "source": F.lit("x")})
    a, b = (language_id.fit(x, landmarks=16) for x in (learned, renamed))
    texts = [r["text"] for r in docs.collect()]
    assert a.predict(texts) == b.predict(texts)


def grams(text):
    words = "".join(c if language_id._letters()[ord(c)] else " " for c in text.lower())
    words = f" {' '.join(words.split())} " if words.split() else " "
    return {words[i : i + n] for n in range(1, 5) for i in range(len(words) - n + 1)}


def test_presence_is_the_set_of_grams():
    texts = ["", "...", "Ab", "x1y", "Ñandú, été!  ét 日本語 😀 aẞ", "the " * 50 + "end", "a" * 300, "\ud800b"]
    seen = {}
    for text in texts:
        own = language_id.presence(text)
        for piece in (1, 2, 3, 7, 50):
            assert (language_id.presence(text, piece) == own).all() or "ẞ" in text
        want = grams(text) if text else set()
        assert len(own) == len(set(own.tolist())) <= max(1, len(want)) and len(own) >= 0.99 * len(want) - 1
        seen[text] = set(own.tolist())
    assert seen["Ab"] == set(language_id.presence(" ab! ").tolist()) != seen["x1y"]


def test_scores_equal_ridge_regression_on_landmarks(make):
    """Every output of the folded product against kernels, sums and a solve in numpy."""
    rng = np.random.default_rng(1)
    alphabet = {"aa": "abcdeé", "bb": "cdefgh", "cc": "хлебыг"}
    rows = [(lang, " ".join("".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(rng.integers(1, 30)))) for lang, letters in alphabet.items() for _ in range({"aa": 40, "bb": 25, "cc": 9}[lang])]
    model = language_id.fit(make(rows, "lang string, text string"), landmarks=12, ridge=0.01)
    own = [set(language_id.presence(t).tolist()) for _, t in rows]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    spark_hash = dict(zip([t for _, t in rows], [r[0] for r in make([(t,) for _, t in rows], "text string").select(F.xxhash64("text")).collect()]))
    marks = [set(language_id.presence(t).tolist()) for lang in alphabet for t in sorted({t for k, t in rows if k == lang}, key=spark_hash.get)[:4]]
    k = np.array([[kernel(a, z) for z in marks] + [1] for a in own])
    among = np.zeros((13, 13))
    among[:12, :12] = [[kernel(a, b) for b in marks] for a in marks]
    y = np.array([[1 if lang == x else -1 for x in alphabet] for lang, _ in rows])
    d = np.array([len(rows) / 3 / sum(k == lang for k, _ in rows) for lang, _ in rows])[:, None]
    want = k @ np.linalg.solve(k.T @ (d * k) + 0.01 * len(rows) * among + 1e-9 * len(rows) * np.eye(13), k.T @ (d * y))
    assert model.languages == list(alphabet)
    assert np.allclose(model.outputs([language_id.presence(t) for _, t in rows]), want, atol=1e-6)


def test_language_edges(make):
    docs = make([(1, "en", "the cat"), (1, "en", "the cat"), (2, None, "le chat"), (3, "fr", "le chat noir"), (4, "fr", None), (5, "xx", "12 34"), (None, "en", "a dog"), (6, "en", "w " * 200_000)], "doc_id long, lang string, text string", extra=("hash", "nth", "entry", "bits"))
    model = language_id.fit(docs, landmarks=4)
    assert model.languages == ["en", "fr"]
    got = [tuple(r[0]) for r in docs.select(language_id.predict(model, F.col("text"))).collect()]
    assert [x[0] for x in got] == ["en", "en", "fr", "fr", "und", "und", "en", "en"] and got[4][1] == got[5][1] == 0
    assert docs.where("false").select(language_id.predict(model, F.col("text"))).count() == 0
    for none in (docs.where("false"), docs.where("lang is null")):
        unlearned = language_id.fit(none)
        assert {tuple(r[0]) for r in docs.select(language_id.predict(unlearned, F.col("text"))).collect()} == {("und", 0.0)}
    alone = language_id.fit(docs.where("lang = 'fr'"))
    assert {r[0][0] for r in docs.select(language_id.predict(alone, F.col("text"))).collect()} == {"fr", "und"}
