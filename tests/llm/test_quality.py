import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatorium.llm import quality

GOOD, JUNK, TOXIC = "the of and river stone light walks slowly", "BUY NOW!!", "vile idiot"


def text(grade, seed, n=60):
    random.seed(seed)
    if grade == 0:
        return " ".join(random.choice(JUNK.split()) + random.choice(["!!", "###"]) for _ in range(n))
    words = [random.choice(GOOD.split()) + random.choice(["", "", ",", "."]) for _ in range(n)]
    if grade == 1:
        words[random.randrange(n)] = random.choice(TOXIC.split())
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, text(i % 3, i, 20 + i % 200), i % 3) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    rated = spark.createDataFrame([(i, 0 if g == 0 else 1, int(g == 1)) for i, _, g in rows if i < 400], "doc_id long, quality int, toxic int")
    return docs, rated


def test_held_out_documents(spark, corpus):
    docs, rated = corpus
    model = quality.train(docs, quality.grades(rated))
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.judged(docs.where("doc_id >= 400"), model).collect()
    assert len(got) == 200 and all(0 <= r["p_clean"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    right = np.mean([r["accepted"] == (r["doc_id"] % 3 == 2) for r in got])
    assert right > 0.95
    by_grade = [np.mean([r["expected_grade"] for r in got if r["doc_id"] % 3 == g]) for g in range(3)]
    assert by_grade == sorted(by_grade)


def test_the_fit_is_the_least_of_its_loss():
    """Against a plain likelihood on a grid around the solution."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    grade = np.digitize(x @ [2.0, -1.0] + rng.logistic(size=300), [-1, 1])
    row, column = np.repeat(np.arange(300), 2), np.tile([0, 1], 300)
    weights, edges = quality.fit(row, column, x.ravel(), grade, 2, ridge=0.0)

    def loss(w, t):
        cut = np.concatenate([[-np.inf], t, [np.inf]])
        s = x @ w
        f = lambda v: 1 / (1 + np.exp(-(v - s)))
        return -np.log(f(cut[grade + 1]) - f(cut[grade])).mean()

    best = loss(weights, edges)
    assert abs(weights - [2, -1]).max() < 0.6
    for i in range(4):
        for step in (-0.05, 0.05):
            moved = np.concatenate([weights, edges])
            moved[i] += step
            assert loss(moved[:2], moved[2:]) >= best - 1e-6


def test_odd_rows(spark, corpus):
    model = quality.train(corpus[0], quality.grades(corpus[1]))
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, " \n", 5), (4, text(2, 5), 5), (4, text(2, 5), 5), (5, text(2, 7, 60_000), 5)],
                                 "doc_id long, text string, accepted int").withColumn("_judged", F.lit("kept"))
    got = quality.judged(docs, model)
    assert got.columns == ["doc_id", "text", "_judged", "expected_grade", "p_clean", "accepted"]
    rows = got.collect()
    assert [r["accepted"] for r in rows] == [False, False, False, True, True, True] and rows[0]["_judged"] == "kept"
    assert [r["expected_grade"] for r in rows[:3]] == [0, 0, 0] and rows[3] == rows[4]


def test_ratings(spark):
    labels = [(1, 1, 0), (1, 0, 0), (1, 1, 1), (2, 1, 1), (3, 0, 1), (4, None, 1), (None, 1, 0), (5, 1, None)]
    got = quality.grades(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert dict(map(tuple, got)) == {1: 2, 2: 1, 3: 0, 5: 2}


def test_no_ratings_no_documents(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(corpus[0], quality.grades(none))
    assert model is None and all(r["accepted"] for r in quality.judged(corpus[0], model).collect())
    model = quality.train(corpus[0], quality.grades(corpus[1]))
    assert quality.judged(corpus[0].where("false"), model).collect() == []


def test_one_grade_only(spark, corpus):
    rated = quality.grades(corpus[1]).where("grade = 2")
    model = quality.train(corpus[0], rated)
    assert all(r["accepted"] for r in quality.judged(corpus[0].where("doc_id % 3 = 2"), model).collect())
