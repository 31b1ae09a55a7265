"""Quality classifier: cumulative-link (ordinal) regression on hashed text.

Ratings 0 to 2 (0 poor, 1 readable but toxic, 2 clean) share one weight vector; ordered thresholds turn the score s into
P(grade <= k) = sigmoid(threshold_k - s). The expected grade and the tail probability P(grade >= 2) follow from that.

Features of a whole text: which words and which beginnings of longer words it has (letters and digits in lower case, hashed to 22
bits; six bytes of a word are its beginning) and how often each shape of word occurs ("Aa,", "A!", and the same word twice in a row), as a share of its words. Only buckets that at least `min_texts` of the
sample's texts have, and whose texts' grades differ from the sample's by chi-squared LEAST_CHI2 or more, carry weights, the
`max_features` most different ones at most.

The model is fitted on at most `sample` rated documents, those of the smallest hash of doc_id; every document is scored. Ratings
of one document are averaged, null ratings are ignored. Without any rating no document is judged: null grades, all kept.
A null text or one without words has grade 0 and is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from curatorium.llm import words
from curatorium.llm.store import keep, packed, unpacked

BITS, GRADES, STEM = 22, 3, 6
SAMPLE, MAX_FEATURES, MIN_TEXTS = 12_000, 8192, 8
LEAST_CHI2 = 20.0  # with two degrees of freedom, one bucket in 20,000 gets there by chance

_WORD = np.arange(256, dtype=np.uint8)
_WORD[65:91] += 32
_IN_WORD = np.array([chr(i).isalnum() or i >= 128 or i == 32 or 9 <= i <= 13 for i in range(256)]) | (np.arange(256) >= 128)
_IN_WORD[[*range(14, 32), 127]] = False
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("A"), ord("a"), ord("a"), ord("0")


def _only(data: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `mask` and the texts' begins among them."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return data[mask], before[starts]


def _stems(lowered: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(text, bucket) keys of the first STEM bytes of every word that is longer."""
    begin, end = words.spans(lowered, begins)
    long = end - begin > STEM
    begin, end = begin[long], end[long]
    # bytes of a stem count +1 where it begins and -1 where it ends; a blank stands for what follows it
    step = np.zeros(len(lowered) + 1, np.int64)
    step[begin] += 1
    step[begin + STEM] -= 1
    inside = np.cumsum(step[:-1]) > 0
    first = np.zeros(len(lowered) + 1, bool)
    first[begin + STEM] = True
    stems = np.where(first[:-1], np.uint8(32), lowered)
    hashed, of = words.word_hashes(*_only(stems, begins, inside | first[:-1]))
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(of))
    return (owner << BITS) | (words.mix(hashed + np.uint64(2)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of every feature of every text, each once."""
    lowered, begins = _only(_WORD[data], starts, _IN_WORD[data])
    hashed, first = words.word_hashes(lowered, begins)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    has = np.unique(np.concatenate([
        (text << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64), _stems(lowered, begins)]))
    shape = _SHAPE[data]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts[:-1][starts[:-1] < len(shape)]] = True
    shaped, of = words.word_hashes(*_only(shape, starts, new))
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1])
    kind = np.concatenate([(words.mix(shaped + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64),
                           np.full(int(again.sum()), 1, np.int64)])
    owner = np.concatenate([np.repeat(np.arange(len(starts) - 1), np.diff(of)), text[again]])
    shapes, times = np.unique((owner << BITS) | kind, return_counts=True)
    share = times / np.maximum(np.diff(of), 1)[shapes >> BITS]
    keys = np.concatenate([has, shapes])
    values = np.concatenate([np.full(len(has), 0.5), 4.0 * share])
    return keys >> BITS, keys & ((1 << BITS) - 1), values


def _texts(values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, starts = words.raw(values)
    for a, b in words.blocks(starts):
        yield a, b, data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]


_SPARSE = StructType([StructField("bucket", ArrayType(IntegerType())), StructField("value", ArrayType(FloatType()))])


@F.arrow_udf(_SPARSE)
def _sparse(values: pa.Array) -> pa.Array:
    counts, buckets, shares = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for a, b, data, starts in _texts(values):
        text, bucket, value = features(data, starts)
        order = np.argsort(text, kind="stable")
        counts.append(np.bincount(text, minlength=b - a))
        buckets.append(bucket[order].astype(np.int32))
        shares.append(value[order].astype(np.float32))
    ends = pa.array(np.cumsum(np.concatenate(counts)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts))) for parts in (buckets, shares)]
    return pa.StructArray.from_arrays(lists, names=_SPARSE.names)


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        text, bucket, value = features(data, starts)
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        used = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(at), bool)
        return np.bincount(text[used], self.weights[at[used]] * value[used], len(starts) - 1)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, one row per text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def _lbfgs(loss, x: np.ndarray, rounds: int = 150, memory: int = 10) -> np.ndarray:
    """Minimise a smooth convex function that returns value and gradient."""
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, past = -slope, []
        for s, y in reversed(steps):
            rate = (s @ direction) / (s @ y)
            direction = direction - rate * y
            past.append(rate)
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), rate in zip(steps, reversed(past)):
            direction = direction + s * (rate - (y @ direction) / (s @ y))
        width, fall = 1.0 if steps else 1 / max(np.linalg.norm(slope), 1), slope @ direction
        while True:
            moved = x + width * direction
            new_value, new_slope = loss(moved)
            if new_value <= value + 1e-4 * width * fall or width < 1e-10:
                break
            width /= 2
        s, y = moved - x, new_slope - slope
        done = abs(value - new_value) <= 1e-7 * max(1.0, abs(value))
        x, value, slope = moved, new_value, new_slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        if done:
            break
    return x


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, ridge: float = 1e-4
        ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalised likelihood. Thresholds are a first one and the logs of the gaps after it."""
    n = len(grade)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, gaps = x[:width], np.exp(x[width + 1 :])
        edges = np.concatenate([[-np.inf], x[width] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, weights[column] * value, n)
        with np.errstate(over="ignore"):
            upper, lower = (1 / (1 + np.exp(score - edges[grade + i])) for i in (1, 0))
        chance = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        by_edge = np.bincount(grade, -up, GRADES)[:-1] + np.bincount(grade, low, GRADES)[1:]
        later = np.cumsum(by_edge[::-1])[::-1]
        slope = np.concatenate([np.bincount(column, (up - low)[row] * value, width), [later[0]], later[1:] * gaps]) / n
        slope[:width] += ridge * weights
        return float(-np.log(chance).mean() + ridge / 2 * weights @ weights), slope

    x = _lbfgs(loss, np.zeros(width + GRADES - 1))
    return x[:width], x[width] + np.concatenate([[0], np.cumsum(np.exp(x[width + 1 :]))])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 readable but toxic, 2 clean, by the mean of a document's ratings."""
    mean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("_q"), F.avg(F.coalesce("toxic", F.lit(0))).alias("_t"))
    return mean.select("doc_id", F.when(F.col("_q") < 0.5, 0).when(F.col("_t") >= 0.5, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, sample: int = SAMPLE, max_features: int = MAX_FEATURES, min_texts: int = MIN_TEXTS
          ) -> Model | None:
    """Fit on at most `sample` documents; `rated` has doc_id and grade. None without any."""
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select(
        "grade", _sparse("text").alias("x"))
    found = keep(found, "rated-features")
    counts = {r["grade"]: r["count"] for r in found.groupBy("grade").count().collect()}
    total = sum(counts.values())
    texts = found.select("grade", F.explode("x.bucket").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in counts])
    # how far a bucket's texts are from the sample's mix of grades
    away = sum((F.pow(F.col(f"n{g}") - F.col("n") * F.lit(c / total), F.lit(2.0)) / (F.col("n") * F.lit(c / total)) for g, c in counts.items()),
               F.lit(0.0))
    used = texts.where(F.col("n") >= min_texts).withColumn("away", away).where(F.col("away") >= LEAST_CHI2).orderBy(
        F.desc("away"), "bucket").limit(max_features)
    buckets = np.sort(np.array([r["bucket"] for r in used.collect()], np.int64))
    # each document brings the used buckets only: sample x max_features entries at most
    rows = found.mapInArrow(_narrowed(buckets), "grade int, at binary, value binary").collect()
    if not rows:
        return None
    at, value = ([np.frombuffer(r[name], kind) for r in rows] for name, kind in (("at", np.int32), ("value", np.float32)))
    row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    weights, thresholds = fit(row, np.concatenate(at), np.concatenate(value).astype(float), np.array([r["grade"] for r in rows]),
                              len(buckets))
    return Model(buckets, weights, thresholds)


def _narrowed(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x").flatten()
            owner = np.repeat(np.arange(len(batch)), lists[0].value_lengths().to_numpy())
            bucket, value = (x.flatten().to_numpy() for x in lists)
            used = np.isin(bucket, buckets)
            cuts = np.searchsorted(owner[used], np.arange(1, len(batch)))
            places = [x.tobytes() for x in np.split(np.searchsorted(buckets, bucket[used]).astype(np.int32), cuts)[: len(batch)]]
            values = [x.tobytes() for x in np.split(value[used], cuts)[: len(batch)]]
            yield pa.RecordBatch.from_pydict({"grade": batch.column("grade"), "at": pa.array(places, pa.binary()),
                                              "value": pa.array(values, pa.binary())})
    return run


def judged(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """All columns, expected_grade (0 to 2), p_clean = P(grade >= 2), and accepted: p_clean is at least `least`. Columns of
    those names are replaced."""
    docs = docs.drop("expected_grade", "p_clean", "accepted")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "p_clean": F.lit(None).cast("double"),
                                 "accepted": F.lit(True)})

    @F.arrow_udf(StructType([StructField("expected_grade", DoubleType()), StructField("p_clean", DoubleType())]))
    def run(values: pa.Array) -> pa.Array:
        out = np.zeros((len(values), 2))
        for a, b, data, starts in _texts(values):
            tails = model.tails(model.score(data, starts))
            _, first = words.word_hashes(data, starts)
            tails[np.diff(first) == 0] = 0
            out[a:b] = np.stack([tails.sum(1), tails[:, -1]], 1)
        # a grade that is no number is null
        return pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in out.T], names=["expected_grade", "p_clean"])

    found = packed(docs).withColumn("_judged", run(F.col("_row.text")))
    return found.select(*unpacked(docs), "_judged.expected_grade", "_judged.p_clean", (F.col("_judged.p_clean") >= least).alias("accepted"))
