import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatorium.llm import voronoi


def brute(rows, asked, k):
    def whole(v):
        return None if not v or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]

    out = []
    for q, v in asked:
        a = whole(v)
        if q is None or a is None:
            continue
        found = [(-sum(x * y for x, y in zip(a, b)), i) for i, w in rows if i is not None and i != q and (b := whole(w)) and len(b) == len(a)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "rank": F.lit(2)})


@pytest.mark.parametrize("spread", [0.05, 1.0, 30.0])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 700)] + spread * rng.normal(size=(700, 8))).astype(np.float32)
    rows = [(int(i * 2), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000 + i, rows[0][1]) for i in range(150)]  # a very common vector
    asked = rows[::9]
    got = voronoi.top_k(frame(spark, rows), frame(spark, asked), k=7, pivots=16, group_queries=20, block=100)
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 7)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]), (7, [1.0, -1.0]), (8, [1.0, -1.0]), (9, [1.0, 2.0, 3.0]),
            (10, [2.0, 2.0, 2.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.25]), (11, [-0.001, 0.01]), (12, [4.0]), (8, [1.0, -1.0])]
    got = voronoi.top_k(frame(spark, rows), frame(spark, rows), k=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, rows, 3)


def test_few_candidates_and_empty_tables(spark):
    two = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert sorted(map(tuple, voronoi.top_k(frame(spark, two), frame(spark, two)).collect())) == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert voronoi.top_k(frame(spark, []), frame(spark, two)).collect() == []
    assert voronoi.top_k(frame(spark, two), frame(spark, [])).collect() == []


def test_bounds_spare_data(spark):
    """Far clusters aren't copied to a group."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 4)) * 0.1 + 10 * np.eye(4)[i] for i in range(4)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    seen = []
    kept = voronoi.keep
    voronoi.keep = lambda df, name: seen.append((name, out := kept(df, name))) or out
    try:
        voronoi.top_k(frame(spark, rows), frame(spark, rows[::10]), k=5, group_queries=20).count()
    finally:
        voronoi.keep = kept
    groups = dict(seen)["bounds"].select("near").distinct().count()
    assert groups > 3 and dict(seen)["needs"].count() < 800 * 3


def test_large_numbers_stay_exact():
    a = np.array([[2**30, 3]], np.int64)
    assert voronoi._products(a, a)[0, 0] == 2**60 + 9
