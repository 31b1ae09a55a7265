"""Object-store listings: newest picture per item and the moves a merge asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---- fixed values: file names ----
LABEL_SUFFIX = ".label.jpg"
CARD_SUFFIX = ".jpg"
# ---- end of fixed values ----

_PATH = r"^([^/]+)/([^/.]+)(\.label)?\.jpg$"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, created_at, updated_at, size) of all files below a folder, from what the file source knows about them; their contents
    are not read. Paths are relative to the folder; stores keep one time only, the last change. Files of no bytes are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("_metadata.*")
    root = folder.split(":", 1)[-1].rstrip("/") + "/"
    changed = F.col("file_modification_time")
    return files.select(
        F.substring_index(F.col("file_path"), root, -1).alias("path"), changed.alias("created_at"), changed.alias("updated_at"), F.col("file_size").alias("size"))


def parse_listing(listing: DataFrame) -> DataFrame:
    """Owner, item and kind from the path; other files are ignored."""
    return (
        listing.where(F.col("path").rlike(_PATH))
        .withColumns({
            "owner": F.regexp_extract("path", _PATH, 1),
            "item": F.regexp_extract("path", _PATH, 2),
            "is_label": F.col("path").endswith(LABEL_SUFFIX),
        })
    )


def newest_object(listing: DataFrame) -> DataFrame:
    """A label picture beats a card picture; within a kind the newest update wins."""
    best = F.struct("is_label", F.coalesce("updated_at", "created_at"), "path")
    return parse_listing(listing).groupBy("item").agg(F.max_by("path", best).alias("path"))


def move_plan(merges: DataFrame, facts: DataFrame, listing: DataFrame) -> DataFrame:
    """For each unmoved merge and owner of the kept item: old path to new path, if the target is free."""
    plan = (
        merges.where("not moved").join(facts.select("user_id", F.col("item_id").alias("kept_id")), "kept_id")
        .select(
            F.concat_ws("", F.col("user_id"), F.lit("/"), F.col("dropped_id"), F.lit(LABEL_SUFFIX)).alias("source"),
            F.concat_ws("", F.col("user_id"), F.lit("/"), F.col("kept_id"), F.lit(LABEL_SUFFIX)).alias("path"),
        )
    )
    return plan.join(listing.select("path"), "path", "left_anti").withColumnRenamed("path", "target")
