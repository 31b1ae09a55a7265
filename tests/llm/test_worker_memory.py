"""What a Python worker holds beside the batch it was sent."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from curatorium.llm import minhash, quality, simhash
from curatorium.operators import ordered


def batch(megabytes):
    words = np.array([f"word{i}" for i in range(5000)])
    draw = np.random.default_rng(3).integers(0, len(words), (400 * megabytes, 300))
    return pa.array([" ".join(words[row]) for row in draw])


def scored(texts):
    model = quality.Model(np.arange(0, 1 << 22, 512), np.ones(1 << 13), np.array([0.0, 1.0]))
    return sum(len(model.score(data, starts)) for _, _, data, starts in quality._texts(texts))


WORK = {
    "quality": scored,
    "hashed": lambda texts: len(minhash._hashed(True).func(texts)),
    "fingerprints": lambda texts: len(simhash._fingerprints.func(texts)),
}


@pytest.mark.parametrize("name", WORK)
def test_work_on_a_batch_takes_less_memory_than_the_batch(name):
    texts = batch(32)
    WORK[name](texts[:10])  # tables that are made once
    pool = pa.system_memory_pool()
    before = pa.set_memory_pool(pool), pool.bytes_allocated()
    tracemalloc.start()
    try:
        arrow = pool.max_memory()
        assert WORK[name](texts) == len(texts)
        taken = tracemalloc.get_traced_memory()[1] + max(0, pool.max_memory() - max(arrow, before[1]))
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(pa.mimalloc_memory_pool())
    assert taken < texts.nbytes


def test_keys_over_borders_start_no_python_workers(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3 == 0 and "a" or None, i, None if i % 5 else 1) for i in range(90)], "k string, n long, v long")

    def refused(*args, **kwargs):
        raise AssertionError("rows made on the driver")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "createDataFrame", refused)
        got = ordered.running(rows, ["k"], ["n"], {"at": ("count", None), "most": ("max", rows["n"])}, 7)
        found = sorted((r["k"] or "", r["n"], r["at"], r["most"]) for r in got.collect())
    want = sorted((k, n, at, n) for k, own in (("a", range(0, 90, 3)), ("", [i for i in range(90) if i % 3])) for at, n in enumerate(own, 1))
    assert found == want
