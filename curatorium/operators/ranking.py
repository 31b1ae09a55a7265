"""Rankings, stacks, milestones and stable paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions.tiers import tier_rank
from curatorium.operators.ordered import first_k, position

# ---- fixed values ----
TOP = 10
MILESTONES = (10, 25, 50, 100)
NEWEST = 60
BATCH = 12
# ---- end of fixed values ----


def compact_ranks(facts: DataFrame) -> DataFrame:
    """Favourites renumbered 1..n without gaps; beyond ten the rank is lost."""
    ranked = facts.where(F.col("fav_rank").isNotNull())
    top = first_k(ranked.select("user_id", "fact_id", "fav_rank"), ["user_id"], ["fav_rank", "fact_id"], TOP, "new_rank")
    return ranked.join(top.select("fact_id", "new_rank"), "fact_id", "left")


def stack_top(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The card on top of each stack: last chosen, else highest tier, else oldest; with the stack's size."""
    first_created = F.max("created_at")
    order = F.struct(
        F.col("top_at").isNotNull().alias("chosen"), F.col("top_at"), tier_rank(F.col("tier")).alias("rank"),
        (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), (-F.col("fact_id")).alias("id"))
    return facts.groupBy(*keys).agg(
        F.max_by("fact_id", order).alias("top_fact"), F.count(F.lit(1)).alias("stack_size"), first_created.alias("newest"))


def milestones(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """When each person reached 10, 25, 50 and 100 different items. `parts`: tasks to deal the facts to, where the planner's
    choice would be too few for their number."""
    dealt = facts.select("user_id", "item_id", "created_at").repartition(parts, "user_id", "item_id") if parts else facts
    firsts = dealt.groupBy("user_id", "item_id").agg(F.min("created_at").alias("created_at"))
    return first_k(firsts, ["user_id"], ["created_at", "item_id"], max(MILESTONES), "n").where(F.col("n").isin(*MILESTONES))


def latest_value(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    return rows.groupBy(*keys).agg(F.max_by(value, known).alias(value))


def newest(items: DataFrame, n: int = NEWEST) -> DataFrame:
    return items.orderBy(F.col("created_at").desc(), F.col("item_id").desc()).limit(n)


def batch_pages(items: DataFrame, size: int = BATCH, parts: int | None = None) -> DataFrame:
    """Page number in the global (created_at, item_id) order, without a global sort in one task."""
    return position(items, [], ["created_at", "item_id"], parts=parts).withColumn(
        "batch", F.floor((F.col("position") - 1) / size).cast("long"))


def album_pages(facts: DataFrame, entry: Column, per_page: int = 9, parts: int | None = None) -> DataFrame:
    """Each person's cards in order of acquisition, nested per page of nine: no page outgrows a row."""
    rows = facts.select("user_id", "created_at", "fact_id", entry.alias("card"))
    numbered = position(rows, ["user_id"], ["created_at", "fact_id"], parts=parts)
    page = F.floor((F.col("position") - 1) / per_page).cast("long").alias("page")
    return numbered.groupBy("user_id", page).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "card"))), lambda e: e["card"]).alias("cards"))
