import random

import corpus_pipeline
import pytest

from curatorium.llm import minhash, simhash


@pytest.mark.parametrize("bands", [True, False])
def test_simhash_finds_what_bands_miss(spark, monkeypatch, bands):
    if not bands:
        # one band of the whole signature: only equal signatures meet
        monkeypatch.setattr(minhash, "BANDS", 1)
        monkeypatch.setattr(minhash, "ROWS", minhash.HASHES)
    random.seed(3)
    rows = []
    for i in range(8):
        w = [f"w{random.randrange(3000)}" for _ in range(800)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join([*w[:400], "changed", *w[401:]]).upper())]
    prints = {i: simhash.simhash(t.encode()) for i, t in rows}
    assert all((prints[10 * i] ^ prints[10 * i + 1]).bit_count() <= 4 for i in range(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [*range(0, 80, 10)]
