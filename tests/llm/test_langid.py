import random

import numpy as np
from pyspark.sql import functions as F

from curatorium.llm import langid

WORDS = {"en": "the of and river stone with which their", "de": "der und nicht für über straße wird auch", "fr": "le été être dans où leçon avec mais"}


def text(lang, seed, n=40):
    random.seed(seed)
    return " ".join(random.choice(WORDS[lang].split()) for _ in range(n))


def corpus(spark, n=150):
    rows = [(i, text(("en", "de", "fr")[i % 3], i, 5 + i % 60), ("en", "de", "fr")[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_presence_is_the_set_of_grams():
    for t in ("", "a", "ab", "abc ABC", "é" * 10):
        low = t.lower()
        grams = {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}
        assert langid.presence([t]).sum() == len(grams)
    long = "abc d" * 200_000
    assert langid.presence([long]).sum() == langid.presence(["abc d" * 3]).sum()


def test_folded_matrix_is_kernel_ridge_regression():
    """With every training text a landmark, scores are those of exact kernel ridge regression."""
    texts = [text(lang, i) for i in range(10) for lang in WORDS]
    names = np.array([lang for i in range(10) for lang in WORDS], object)
    rows = langid.presence(texts)
    model = langid.fit(rows, names, landmarks=30, ridge=1e-3)
    unit = rows / np.sqrt(rows.sum(1, keepdims=True))
    kernel = unit @ unit.T
    y = np.where(names[:, None] == np.array(sorted(WORDS))[None, :], 1.0, -1.0)
    fresh = langid.presence([text("de", 99), text("en", 98)])
    want = ((fresh / np.sqrt(fresh.sum(1, keepdims=True))) @ unit.T) @ np.linalg.solve(kernel + 1e-3 * 30 * np.eye(30), y)
    got = (fresh @ model.matrix) / np.sqrt(fresh.sum(1, keepdims=True))
    assert np.abs(got - want).max() < 0.01


def test_held_out_accuracy_and_odd_rows(spark):
    docs = corpus(spark)
    model = langid.train(docs.where("doc_id < 90").union(docs.limit(1).select("doc_id", F.lit(None), "lang")).union(
        docs.limit(1).select("doc_id", "text", F.lit(None))))
    assert model.languages == ["de", "en", "fr"]
    got = langid.identified(docs.where("doc_id >= 90"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) == 1 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, text("de", 1)), (5, text("fr", 3, 50_000))], "doc_id long, text string")
    odd = odd.withColumns({"score": F.lit("old"), "_found": F.lit("kept")})
    rows = langid.identified(odd, model).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "de", "fr"]
    assert [r["score"] for r in rows[:3]] == [0, 0, 0] and rows[0]["_found"] == "kept"


def test_copies_in_the_training_rows_count_once(spark):
    docs = corpus(spark, 30)
    many = docs.union(docs.where("doc_id = 0").crossJoin(spark.range(500)).drop("id"))
    a, b = langid.train(docs), langid.train(many)
    assert np.allclose(a.matrix, b.matrix)


def test_nothing_learned(spark):
    docs = corpus(spark, 6)
    assert langid.train(docs.where("false")) is None
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}
    assert langid.identified(docs.where("false"), langid.train(docs)).collect() == []
