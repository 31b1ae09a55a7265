"""The corpus pipeline: raw documents in, an encoded training mix out.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curatorium.llm import bpe, lines, minhash, mixing, quality
from curatorium.llm.queries import rank_file, table
from curatorium.llm.store import keep


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rates clean: P(grade >= 2) is 0.5 or more."""
    model = quality.train(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.judged(docs, model).where("accepted").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sites, whatever their share; whole copies stay whole."""
    cleaned = lines.without_boilerplate(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (5-word shingles, Jaccard 0.8 or more), that of the smallest doc_id. SimHash
    links of up to 4 bits and MinHash bands bring texts together; the likeness of what they bring is verified."""
    return minhash.one_of_each(docs, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with their token ids, and whether the ids decode to the text's bytes."""
    return bpe.encoded(docs, *rank_file())


STAGES = [
    ("quality", accept_quality),
    ("lines", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode),
]
# a trained model, SimHash and BPE are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
