"""Rule catalogues: nested JSON in the package or on storage, flattened to one row per slot."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

FOLDER = Path(__file__).resolve().parents[1] / "plans" / "catalogue"
RULE_FIELDS = ("region", "app", "grape", "country", "style", "color", "tag", "key", "has")
SET_SCHEMA = (
    "id string, name string, part int, country string, unlock string, secret boolean, always boolean, "
    "slots array<struct<slot: string, difficulty: int, rule: struct<region: string, app: array<string>, grape: string, "
    "country: string, style: string, color: string, tag: string, key: string, has: array<string>>, "
    "guide: struct<text: string, price: string, tip: string>>>"
)


def packaged(name: str) -> list[dict]:
    return json.loads((FOLDER / f"{name}.json").read_text(encoding="utf-8"))


def literal_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table carried in the plan itself: one task, no Python worker, no file."""
    text = F.lit(json.dumps(rows, ensure_ascii=False))
    parsed = F.from_json(text, f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.explode(parsed).alias("r")).select("r.*")


def sets_frame(spark: SparkSession, sets: list[dict]) -> DataFrame:
    """A small catalogue held in memory; `read_sets` takes one from storage."""
    return literal_frame(spark, sets, SET_SCHEMA)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SET_SCHEMA).json(path, multiLine=True)


def slots(sets: DataFrame) -> DataFrame:
    """One row per slot; a missing rule field stays null and matches anything."""
    return (
        sets.select(
            F.col("id").alias("set_id"), F.col("name").alias("set_name"), "part", F.col("country").alias("set_country"),
            "unlock", F.coalesce("secret", F.lit(False)).alias("secret"), F.coalesce("always", F.lit(False)).alias("always"),
            F.posexplode("slots").alias("position", "s"),
        )
        .select("set_id", "set_name", "part", "set_country", "unlock", "secret", "always", "position",
                "s.slot", "s.difficulty", "s.rule", "s.guide")
    )
