"""Line dedup by spread over sites, in DataFrame operations only.

A line is what lies between line feeds, without blanks at its ends; empty lines are never boilerplate. For each line's hash a
HyperLogLog sketch of the sites that have it is merged by aggregation. Lines estimated well above `min_sites` are boilerplate, well
below they are not; those in between get exact distinct counts. A null site is one site of its own.

Boilerplate lines are removed wherever they stand and whatever their share; the rest of a text stays as it is, line feeds of kept
lines included. A line of more than LONG_WORDS words is boilerplate from `long_sites` sites on: so long a passage does not
come about by chance. Two kinds of documents stay whole, for near-dedup to judge: those whose whole text stands under
several keys, and those of which nothing but blanks would be left. Null and empty texts stay.

Texts move once (joined to their own boilerplate positions); else only hashes do. Hashes take 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.llm.store import keep, packed, unpacked
from curatorium.operators.bounded import small_or_shuffled

MIN_SITES, LONG_SITES, LONG_WORDS = 8, 5, 50
LOG_REGISTERS = 10  # standard error about 3 %; sketches of a few sites are exact


def _line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.trim(line))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES, text: str = "text",
                site: str = "source") -> DataFrame:
    """(h, g): hashes of the lines that stand on `min_sites` different sites or more, long ones on `long_sites`."""
    is_long = F.size(F.split(F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")) > LONG_WORDS
    lines = keep(
        docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("none")).alias("site"),
                    F.explode(_lines(F.col(text))).alias("line"))
        .where("line <> ''").select("site", _line_hash(F.col("line")).alias("x"), is_long.alias("long")).select("site", "x.*", "long"), "lines")
    spread = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"),
        F.when(F.max("long"), min(long_sites, min_sites)).otherwise(min_sites).alias("least"))
    # six standard errors on both sides, one site at least
    slack = F.greatest(F.lit(1), F.round(0.2 * F.col("least")).cast("int"))
    spread = keep(spread.where(F.col("sites") >= F.col("least") - slack), "spread-lines")
    sure = spread.where(F.col("sites") > F.col("least") + slack).select("h", "g")
    unsure = spread.where(F.col("sites") <= F.col("least") + slack).select("h", "g", "least")
    exact = lines.select("h", "g", "site").join(unsure, ["h", "g"]).distinct().groupBy("h", "g", "least").agg(F.count(F.lit(1)).alias("sites"))
    return sure.union(exact.where(F.col("sites") >= F.col("least")).select("h", "g"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES, text: str = "text",
                        site: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns with the cleaned text, and n_lines, n_removed (lines found to be boilerplate and removed). Columns of those
    names are replaced. Rows with equal key and text are cleaned alike; the key may be null (all null keys count as one)."""
    docs = docs.drop("n_lines", "n_removed")
    bad = keep(boilerplate(docs, min_sites, long_sites, text, site), "boilerplate")
    same, own = F.xxhash64(F.col(text)), [F.col("_key"), F.col("_same"), F.col("_twin")]
    placed = docs.select(F.col(key).alias("_key"), same.alias("_same"), F.xxhash64(F.lit("second"), F.col(text)).alias("_twin"),
                         F.posexplode(_lines(F.col(text))).alias("_at", "_line")).select(
        *own, "_at", _line_hash(F.col("_line")).alias("_x")).select(*own, "_at", "_x.*")
    hits = placed.join(bad, ["h", "g"], "left_semi").groupBy(*own).agg(F.collect_set("_at").alias("_bad"))
    # equal texts have equal hits, so the hits tell the copies; one row per key and text
    hits = keep(hits, "hits")
    copies = keep(hits.groupBy("_same", "_twin").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "_same", "_twin", F.lit(True).alias("_copy")), "copies")
    hits = hits.join(small_or_shuffled(copies), ["_same", "_twin"], "left")
    body = F.col(f"_row.`{text}`")
    joined = packed(docs).withColumn("_of", F.xxhash64(body)).join(
        hits, F.col(f"_row.`{key}`").eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_same")), "left")
    parts = F.split(body, "\n")
    rest = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("_bad", i)), "\n")
    fits = F.col("_copy").isNull() & F.col("_rest").rlike(r"[^ \n]")
    cleaned = joined.withColumn("_rest", F.when(F.col("_bad").isNotNull(), rest)).withColumn("_cut", F.col("_rest").isNotNull() & fits)
    return cleaned.select(
        *unpacked(docs, {text: F.when(F.col("_cut"), F.col("_rest")).otherwise(body)}),
        F.when(body.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"),
        F.when(F.col("_cut"), F.size("_bad")).otherwise(0).alias("n_removed"))
