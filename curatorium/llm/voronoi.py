"""Exact top-k search by inner product: a Voronoi kNN join.

Inner products become distances: with M the largest norm of the data, a vector x gets the further component sqrt(M^2 - |x|^2)
and a query the component 0; the nearest then have the largest products. Pivots are `pivots` data vectors of smallest hash; data
belong to their nearest pivot's cell, whose summary is the k + 1 smallest distances (one may be the query itself).

Each query's bound is the (k + 1)-th smallest distance that the summaries guarantee (later by one for each further row of its own
id). Queries are grouped by their pivots; a
group needs of a cell only the data whose distance to the pivot lies in the range that some query's bound leaves open, by the triangle
inequality, widened by the rounding error. Those are copied to the group, cut into blocks of bounded size, and solved as matrix
products; the best k of all blocks are merged. No bound is a guess: every row that could be among the best takes part.

Vectors that are null or empty, or hold null, NaN or infinite components, and rows without vec_id take no part; only vectors of the same number of components are
compared. Each component x becomes floor(scale * x) as an integer; scores are exact as long as they fit in 63 bits. Ties go to the
smaller vec_id; repeated ids are rows and queries of their own, and a query never meets a row of its own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from curatorium.llm.store import keep

PIVOTS, MOST_PIVOTS, GROUP_QUERIES, BLOCK = 64, 1024, 1024, 4096


def integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, dim, v, norm2): the usable vectors, v holding 64-bit integers."""
    x = F.col("embedding")
    good = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    rows = vectors.where(good & F.col("vec_id").isNotNull()).select("vec_id", F.size(x).alias("dim"), whole.alias("x"))

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda a: np.asarray(a, "<i8").tobytes())

    norm = F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return rows.where("dim > 0").select("vec_id", "dim", pack("x").alias("v"), norm.alias("norm2"))


def _stack(values) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i8") for v in values])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every partial sum is below 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**53 else a @ b.T


def _distances(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    full = np.concatenate([rows.astype(np.float64), extra[:, None]], 1)
    marks = np.concatenate([pivots.astype(np.float64), pivot_extra[:, None]], 1)
    square = (full**2).sum(1)[:, None] + (marks**2).sum(1)[None, :] - 2 * full @ marks.T
    return np.sqrt(np.maximum(square, 0))


def _search(data: DataFrame, queries: DataFrame, dim: int, k: int, pivots: int | None, group_queries: int, block: int) -> DataFrame:
    spark = data.sparkSession
    count, top = data.agg(F.count(F.lit(1)), F.max("norm2")).first()
    # as many pivots as the root of the number of vectors, so cells grow slower than the data; a bounded number in the end,
    # since each query has a bound per pivot. Equal vectors are one pivot
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(count)))
    marks = np.unique(_stack([r["v"] for r in data.dropDuplicates(["v"]).orderBy(F.xxhash64("v")).limit(pivots).collect()]), axis=0)
    marks_norm = (marks.astype(np.float64) ** 2).sum(1)
    far = float(top)
    mark_extra = np.sqrt(np.maximum(far - marks_norm, 0))
    # rounding: squares of distances are sums of dim + 1 terms below 4 * far
    slip = np.sqrt(64 * (dim + 2) * np.finfo(float).eps * 4 * max(far, 1.0, float(queries.agg(F.max("norm2")).first()[0] or 0)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                near = _distances(_stack(rows["v"]), np.sqrt(np.maximum(far - rows["norm2"].to_numpy(), 0)), marks, mark_extra)
                cell = near.argmin(1)
                yield pd.DataFrame({"vec_id": rows["vec_id"], "v": rows["v"], "cell": cell.astype(np.int32),
                                    "d": near[np.arange(len(near)), cell]})

    placed = keep(data.select("vec_id", "v", "norm2").mapInPandas(assign, "vec_id long, v binary, cell int, d double"), "cells")
    # of each cell the k + 1 nearest: pivots x (k + 1) numbers
    close = placed.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in close.select("cell", "d").collect():
        nearest.setdefault(r["cell"], []).append(r["d"])
    flat_cell = np.array([c for c, ds in nearest.items() for _ in ds], np.int64)
    flat_d = np.array([x for ds in nearest.values() for x in ds])

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                to = _distances(_stack(rows["v"]), np.zeros(len(rows)), marks, mark_extra)
                sure = np.sort(to[:, flat_cell] + flat_d[None, :], axis=1)
                sure = np.concatenate([sure, np.full((len(rows), 1), np.inf)], 1)
                # the k-th besides the rows of the query's own id
                limit = sure[np.arange(len(rows)), np.minimum(k - 1 + rows["same"], sure.shape[1] - 1)] + slip
                yield pd.DataFrame({"q": rows["q"], "vec_id": rows["vec_id"], "v": rows["v"], "near": to.argmin(1).astype(np.int32),
                                    "low": list(np.maximum(to - limit[:, None] - slip, 0)), "high": list(to + limit[:, None] + slip)})

    repeated = data.groupBy("vec_id").agg(F.count(F.lit(1)).alias("same")).where("same > 1")
    asked = queries.join(repeated, "vec_id", "left").select("q", "vec_id", "v", F.coalesce("same", F.lit(1)).alias("same"))
    asked = keep(asked.mapInPandas(
        bound, "q long, vec_id long, v binary, near int, low array<double>, high array<double>"), "bounds")
    sizes = {r["near"]: r["count"] for r in asked.groupBy("near").count().collect()}
    group_of = _groups(sizes, _distances(marks, mark_extra, marks, mark_extra), group_queries)
    groups = spark.createDataFrame([(int(c), int(g)) for c, g in group_of.items()], "near int, group int")
    asked = asked.join(F.broadcast(groups), "near")
    # for each group and cell the open range of distances: groups x pivots numbers
    each = asked.select("group", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "b")).groupBy("group", "cell").agg(
        F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    ranges = keep(each, "ranges")
    needs = placed.join(F.broadcast(ranges), "cell").where("d between low and high").select("group", "vec_id", "v")
    needs = keep(needs, "needs")
    many = needs.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    slices = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / group_queries).cast("int").alias("slices"))
    shape = many.join(slices, "group")
    deal = lambda c: F.pmod(F.xxhash64("vec_id", "v"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    right = needs.join(F.broadcast(shape), "group").select("group", every("slices").alias("slice"), deal("blocks").alias("block"),
                                                           F.lit(None).cast("long").alias("q"), "vec_id", "v")
    left = asked.join(F.broadcast(shape), "group").select("group", F.pmod(F.xxhash64("q"), "slices").cast("int").alias("slice"),
                                                          every("blocks").alias("block"), "q", "vec_id", "v")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ask, have = rows[rows["q"].notna()], rows[rows["q"].isna()]
        out = []
        if len(ask) and len(have):
            ids, data_v, own = have["vec_id"].to_numpy(), _stack(have["v"]), ask["vec_id"].to_numpy()
            ask_v, row = _stack(ask["v"]), ask["q"].to_numpy(np.int64)
            for at in range(0, len(ask), 256):
                score = _products(ask_v[at : at + 256], data_v)
                other = ids[None, :] != own[at : at + 256, None]
                for q, query, values, mine in zip(row[at : at + 256], own[at : at + 256], score, other):
                    allowed = np.flatnonzero(mine)
                    if len(allowed) > k:
                        least = -np.partition(-values[allowed], k - 1)[k - 1]
                        allowed = allowed[values[allowed] >= least]
                    # rows are in order of their ids, so a stable sort breaks ties as wanted
                    best = allowed[np.argsort(-values[allowed], kind="stable")][:k]
                    out.append((np.full(len(best), q), np.full(len(best), query), ids[best], values[best]))
        if not out:
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.DataFrame(dict(zip(("q", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    return left.union(right).groupBy("group", "slice", "block").applyInPandas(solve, "q long, query_id long, vec_id long, score long")


def _groups(sizes: dict[int, int], apart: np.ndarray, most: int) -> dict[int, int]:
    """Cells of near pivots together, until a group has `most` queries."""
    out, left, group = {}, sorted(sizes), 0
    while left:
        at, full = left[0], 0
        for cell in sorted(left, key=lambda c: (apart[at, c], c)):
            if full and full + sizes[cell] > most:
                break
            out[cell] = group
            full += sizes[cell]
        left, group = [c for c in left if c not in out], group + 1
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, pivots: int | None = None,
          group_queries: int = GROUP_QUERIES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best rows of `vectors`, both with vec_id and embedding."""
    data, asked = keep(integers(vectors, scale), "vectors"), keep(
        integers(queries, scale).withColumn("q", F.monotonically_increasing_id()), "queries")
    # one search per number of components that queries have
    dims = [r["dim"] for r in asked.select("dim").distinct().join(data.select("dim").distinct(), "dim").orderBy("dim").collect()]
    parts = [_search(data.where(F.col("dim") == d), asked.where(F.col("dim") == d), d, k, pivots, group_queries, block) for d in dims]
    none = vectors.sparkSession.createDataFrame([], "q long, query_id long, vec_id long, score long")
    found = none
    for part in parts:
        found = found.union(part)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
