"""Set-based writes: upserts, replacements and updates that follow another table.

Each returns the new snapshot; `sources.sinks` decides where it is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.operators.bounded import small_or_shuffled


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the last by `order`. max_by combines map-side, so no key is ever gathered."""
    others = [c for c in df.columns if c not in keys]
    position = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*others)
    return df.groupBy(*keys).agg(F.max_by(row, position).alias("_row")).select(*keys, "_row.*")


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The base, one row per key, after the delta's last writes. The delta is reduced to a row per key; each of them meets the
    base's row in one join, in which the later one wins. Keys aren't null."""
    columns = base.columns
    new = latest(delta.select(*columns), keys, order).select(*keys, F.struct(*columns).alias("_new"))
    old = base.select(*keys, F.struct(*columns).alias("_old"))

    def at(row: str) -> Column:
        return F.struct(*[F.col(row)[o].alias(f"o{i}") for i, o in enumerate(order)])

    keep = F.col("_new").isNull() | (at("_old") > at("_new"))
    return old.join(new, keys, "full").select(F.when(F.col("_old").isNotNull() & keep, F.col("_old")).otherwise(F.col("_new")).alias("r")).select("r.*")


def upsert_counter(base: DataFrame, delta: DataFrame, keys: list[str], counter: str) -> DataFrame:
    return base.unionByName(delta).groupBy(*keys).agg(F.sum(counter).alias(counter))


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing keys win; of several new rows with one key the first by `order` is kept."""
    position = F.struct(*order)
    others = [c for c in delta.columns if c not in keys]
    fresh = (
        delta.join(base.select(*keys), keys, "left_anti")
        .groupBy(*keys).agg(F.min_by(F.struct(*others), position).alias("_row")).select(*keys, "_row.*")
    )
    return base.unionByName(fresh)


def replace_or_delete(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str], items: str) -> DataFrame:
    """The last write per key wins, and an empty list removes the row."""
    return upsert_latest(base, delta, keys, order).where(F.size(items) > 0)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Take `column` from the source where it has one; `changed` marks null-safe differences."""
    new = source.select(*keys, F.col(column).alias("_new"))
    joined = target.join(new, keys, "left")
    value = F.coalesce(F.col("_new"), F.col(column))
    return joined.withColumn("changed", ~value.eqNullSafe(F.col(column))).withColumn(column, value).drop("_new")


def follow_item_tier(facts: DataFrame, items: DataFrame) -> DataFrame:
    return update_from(facts, items, ["item_id"], "tier")


def open_reviews(proposals: DataFrame, done: DataFrame) -> DataFrame:
    """Proposals that change the tier and were not settled after they were made."""
    settled = done.groupBy("item_id").agg(F.max("done_at").alias("done_at"))
    return (
        proposals.where(F.col("old_tier") != F.col("new_tier"))
        .join(settled, "item_id", "left")
        .where(F.col("done_at").isNull() | (F.col("done_at") < F.col("proposed_at")))
        .drop("done_at")
    )


def both_ends(edges: DataFrame) -> DataFrame:
    """Every undirected edge (a < b) seen from either end."""
    return edges.select("*", F.explode(F.array(
        F.struct(F.col("a").alias("user_id"), F.col("b").alias("friend_id")),
        F.struct(F.col("b").alias("user_id"), F.col("a").alias("friend_id")))).alias("_e")).select(
        "_e.user_id", "_e.friend_id", *[c for c in edges.columns if c not in ("a", "b")])
