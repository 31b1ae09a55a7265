"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the character n-grams, n = 1 to 3, that both have, divided by the root
of the product of their numbers; texts are in lower case, n-grams hashed to 2^14 buckets. `landmarks` texts, shared evenly
among the languages, give the Nyström map, and ridge regression of one language against the rest (+1, -1) is solved in it. As the
kernel is an inner product, landmarks and coefficients fold into one matrix, and texts are scored by batched products with it.

Learned from at most `per_language` different texts of each language, those of the smallest hash; rows without text or
language teach nothing. A text that is null or has no letter is "und" with score 0; so is every text if nothing was learned.
The score is the regression's value for the chosen language, moved from [-1, 1] to [0, 1]; ties go to the first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from curatorium.llm import words
from curatorium.llm.store import packed, unpacked
from curatorium.operators.bounded import small_or_shuffled

BUCKETS, LONGEST = 1 << 14, 3
PER_LANGUAGE, LANDMARKS, RIDGE = 400, 128, 1e-4
_STEP = 1 << 18  # characters hashed at a time
_ROWS = 64
DEALS = 64


def presence(texts: list[str]) -> np.ndarray:
    """One row of 0 and 1 per text: the buckets of its n-grams."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        for at in range(0, len(codes), _STEP):
            part = codes[at : at + _STEP + LONGEST - 1].astype(np.uint64) + np.uint64(1)
            run = np.zeros(len(part), np.uint64)
            for n in range(LONGEST):
                if len(part) <= n:
                    break
                run = run[: len(part) - n] * np.uint64(0x9E3779B97F4A7C15) + part[n:]
                row[(words.mix(run) >> np.uint64(64 - 14)).astype(np.int64)] = 1
    return out


@F.pandas_udf(BinaryType())
def _packed(values: pd.Series) -> pd.Series:
    return values.map(lambda t: np.packbits(presence([t])[0].astype(np.uint8)).tobytes())


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # buckets x languages

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        best, score = [], []
        for at in range(0, len(texts), _ROWS):
            rows = presence(texts[at : at + _ROWS])
            size = np.maximum(rows.sum(1, keepdims=True), 1)
            values = (rows @ self.matrix) / np.sqrt(size)
            best.append(values.argmax(1))
            score.append(np.clip((values.max(1) + 1) / 2, 0, 1))
        return np.concatenate(best), np.concatenate(score)


def fit(rows: np.ndarray, languages: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: presence of the training texts; the first of each language serve as landmarks."""
    names = sorted(set(languages))
    share = max(1, landmarks // len(names))
    unit = rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
    chosen = np.concatenate([np.flatnonzero(languages == name)[:share] for name in names])
    marks = unit[chosen].astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    solid = values > 1e-8 * values[-1]
    to_map = vectors[:, solid] / np.sqrt(values[solid])
    mapped = (unit @ marks.T) @ to_map
    target = np.where(languages[:, None] == np.array(names)[None, :], 1.0, -1.0)
    inner = mapped.T @ mapped + ridge * len(rows) * np.eye(mapped.shape[1])
    return Model(names, (marks.T @ (to_map @ np.linalg.solve(inner, mapped.T @ target))).astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on the texts and `lang` of docs. Only packed presence vectors, 2 KB each, reach the driver."""
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & has_letter(F.col("text"))).withColumn(
        "hash", F.xxhash64("text"))
    hashes, keys = rows.select("lang", "hash").distinct(), ["lang", F.pmod("hash", F.lit(DEALS))]
    # the smallest hashes of each language, first of each deal of it, so that a common language isn't one task's work
    for by in (keys, keys[:1]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
        hashes = hashes.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    last = hashes.groupBy("lang").agg(F.max("hash").alias("last"))
    few = rows.join(small_or_shuffled(last), "lang").where("hash <= last").groupBy("lang", "hash").agg(F.min("text").alias("text"))
    found = few.select("lang", "hash", _packed("text").alias("bits")).orderBy("lang", "hash").collect()
    if not found:
        return None
    bits = np.stack([np.frombuffer(r["bits"], np.uint8) for r in found])
    return fit(np.unpackbits(bits, axis=1).astype(np.float32), np.array([r["lang"] for r in found], object), landmarks)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns, lang_pred and score; columns of those names are replaced. Only the text is looked at."""
    docs = docs.drop("lang_pred", "score")
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    @F.pandas_udf(kind)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in values:
            given = texts.isna()
            best, score = model.predict(texts.fillna("").tolist())
            names = np.array(model.languages, object)[best]
            yield pd.DataFrame({"lang_pred": names, "score": np.where(given, 0.0, score)})

    # a text without letters is not sent to Python
    found = packed(docs).withColumn("_letters", has_letter(F.col("_row.text"))).withColumn(
        "_found", run(F.when(F.col("_letters"), F.col("_row.text"))))
    found = found.withColumn("_found", F.when(F.col("_letters"), F.col("_found")).otherwise(nothing))
    return found.select(*unpacked(docs), "_found.lang_pred", "_found.score")
