"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curatorium.sources.sinks import shared_folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later uses neither compute it again nor depend on the executors that did."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, rows: int, rows_per_part: int = 200_000) -> int:
    """Partitions by the number of rows, and at least as many as the session shuffles into."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part))


def packed(df: DataFrame, row: str = "_row") -> DataFrame:
    """All columns as one struct, so that columns added for the work can't clash with them; `unpacked` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row))


def unpacked(like: DataFrame, replaced: dict | None = None, row: str = "_row") -> list:
    """The columns of `like` out of the struct, some of them replaced."""
    return [(replaced or {}).get(c, F.col(f"{row}.`{c}`")).alias(c) for c in like.columns]


def attach(rows: DataFrame, names: DataFrame, key: str, many: str = "_n", share: int = 200) -> DataFrame:
    """`rows` left-joined to `names` (one row a key, with the number of its rows in `many`, which is dropped).

    Keys with more than one row in `share` of all are at most `share`, so they are broadcast; only the others are shuffled, and no
    task gets more than that part of the rows for one key."""
    hot = keep(names.where(F.col(many) * share > rows.count()).drop(many), "hot-keys")
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        names.join(F.broadcast(hot.select(key)), key, "left_anti").drop(many), key, "left")
    return usual.unionByName(rows.join(F.broadcast(hot), key))


def one_text_each(docs: DataFrame, rows: DataFrame, wanted: DataFrame, key: str = "content") -> DataFrame:
    """(text) of one row of every wanted key; `rows` has (doc_id, row_hash, key) of all of `docs`, row_hash being xxhash64 of the
    text with null as empty. Only rows equal in id and text can still come several times."""
    from curatorium.operators.bounded import small_or_shuffled

    first = rows.groupBy(key).agg(F.min(F.struct("doc_id", "row_hash")).alias("_r")).join(wanted, key, "left_semi")
    chosen = keep(first.select(F.col("_r.doc_id").alias("_id"), F.col("_r.row_hash").alias("_hash")).distinct(), "chosen-rows")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_own"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    return texts.join(small_or_shuffled(chosen), same, "left_semi").select("text")
