import random

import corpus_pipeline
from pyspark.sql import functions as F

from curatorium.llm import simhash
from test_minhash import classes


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept(rows):
    """Ids that brute-force 5-word Jaccard leaves, and all classes."""
    found = classes([(i, lowered(t)) for i, t in rows])
    return sorted(d for (_, d), c in found if d == c)


def test_changed_words_are_found_and_likeness_is_verified(spark):
    random.seed(7)
    rows = []
    for i in range(20):
        w = [f"w{random.randrange(3000)}" for _ in range(400)]
        rows.append((10 * i, " ".join(w)))
        for k, changes in enumerate((4, 8), 1):
            v = list(w)
            for at in range(20, 400, 360 // changes)[:changes]:
                v[at] = f"new{i}"
            rows.append((10 * i + k, " ".join(v).upper() if i % 2 else " ".join(v)))
    # short texts of one shingle each are within few bits only by chance; half of the words differ here
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == kept(rows) == [*range(0, 200, 10), 1000, 1002]
    prints = {i: simhash.simhash((t or "").encode()) for i, t in rows}
    assert sum((prints[i] ^ prints[i + k]).bit_count() > 4 for i in range(0, 200, 10) for k in (1, 2)) > 10


def test_alike_bits_alone_drop_nothing(spark):
    random.seed(11)
    # one phrase repeated sets all bits; the other words of both texts are few beside it, but most of their different shingles
    common = "the same five words again " * 60
    rows = [(i, common + " ".join(f"x{i}.{j}" for j in range(12))) for i in (1, 2)]
    a, b = (simhash.simhash(t.encode()) for _, t in rows)
    assert (a ^ b).bit_count() <= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(rows) == [1, 2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == kept(rows)
