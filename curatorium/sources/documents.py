"""Label documents: JSON files with an array of drawn elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatorium.functions.signals import ELEMENT_SCHEMA

DOCUMENT_SCHEMA = (
    "item string, name string, style struct<v: int, paper: string, ink: string, metal: string, border: string, "
    f"border_color: string, key: array<string>, els: array<{ELEMENT_SCHEMA}>>"
)


def read_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One document per line by default, which splits; `whole_files` reads pretty-printed files."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=whole_files)


def elements(documents: DataFrame) -> DataFrame:
    return documents.select("item", "name", F.posexplode("style.els").alias("position", "e")).select(
        "item", "name", "position", "e.*"
    )
