"""Friend lists, shared items and taste match, for all edges at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions.text import display_name, natural_key
from curatorium.operators.facts import both_ends
from curatorium.operators.progress import style_tag

# ---- fixed values ----
REGION_SHARE, COLOR_SHARE, SHARED_SHARE = 0.5, 0.25, 0.25
DEFAULT_COVER = "bordeaux"
# ---- end of fixed values ----


WORD = 63  # items to a long


def shared_items(edges: DataFrame, facts: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, shared): different items both own, equal by natural key, or by id where a name is missing.

    A collection is a bitmap in rows of WORD neighbouring item numbers. Only the rows of the smaller one of an edge's two
    collections are looked up in the other, and what both have is counted as bits; so a person with a huge album costs
    nothing per small friend, and two of them cost their bitmaps.
    """
    # equal keys share one number, so the big shuffles below carry three longs instead of text
    keys = items.select("item_id", F.coalesce(
        natural_key(F.col("maker"), F.col("name")), F.concat(F.lit("#"), "item_id")).alias("key"))
    keyed = keys.join(keys.groupBy("key").agg(F.min("item_id").alias("same")), "key").select(
        "item_id", F.floor(F.col("same") / WORD).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(same, {WORD}) as int))").alias("bit"))
    owned = facts.select("user_id", "item_id").join(keyed, "item_id").groupBy("user_id", "word").agg(F.bit_or("bit").alias("bits"))
    sizes = owned.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    sized = (
        edges.select("a", "b").join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
        .select("a", "b", F.when(F.col("size_a") <= F.col("size_b"), F.col("a")).otherwise(F.col("b")).alias("small"),
                F.when(F.col("size_a") <= F.col("size_b"), F.col("b")).otherwise(F.col("a")).alias("large"))
    )
    probes = sized.join(owned.toDF("small", "word", "_bits"), "small")
    both = probes.join(owned.withColumnRenamed("user_id", "large"), ["large", "word"])
    counts = both.groupBy("a", "b").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("_bits")))).cast("long").alias("shared"))
    return edges.select("a", "b").join(counts, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def _counts(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Per person a map value -> count; its size is the number of regions or colours, not of cards."""
    counts = rows.select("user_id", value.alias("v")).where(F.col("v").isNotNull()).groupBy("user_id", "v").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias(name), F.sum(F.col("n") * F.col("n")).alias(name + "_sq"))


def profiles(facts: DataFrame, items: DataFrame) -> DataFrame:
    rows = facts.select("user_id", "item_id").join(items.select("item_id", "region", "country", "style", "color"), "item_id")
    regions = _counts(rows, F.coalesce(F.nullif("region", F.lit("")), "country"), "regions")
    colors = _counts(rows, style_tag(F.col("style"), F.col("color")), "colors")
    sizes = facts.groupBy("user_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(regions, "user_id", "left").join(colors, "user_id", "left")


def _cosine(name: str) -> Column:
    a, b = F.col("pa." + name), F.col("pb." + name)
    dot = F.aggregate(F.map_entries(a), F.lit(0).cast("long"), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))
    norm = F.col(f"pa.{name}_sq") * F.col(f"pb.{name}_sq")
    return F.coalesce(dot / F.sqrt(norm.cast("double")), F.lit(0.0))


def cosine_counts(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Cosine of the region and of the colour counts per edge, 0 without data, and the sizes."""
    e = edges.select("a", "b").alias("e")
    joined = e.join(people.alias("pa"), F.col("e.a") == F.col("pa.user_id"), "left").join(
        people.alias("pb"), F.col("e.b") == F.col("pb.user_id"), "left")
    return joined.select(
        "e.a", "e.b", _cosine("regions").alias("region_cos"), _cosine("colors").alias("color_cos"),
        F.coalesce("pa.size", F.lit(0)).alias("size_a"), F.coalesce("pb.size", F.lit(0)).alias("size_b"))


def taste_match(cosines: DataFrame, shared: DataFrame) -> DataFrame:
    joined = cosines.join(shared, ["a", "b"])
    smaller = F.greatest(F.lit(1), F.least("size_a", "size_b"))
    overlap = F.least(F.lit(1.0), F.col("shared") / smaller * 2)
    score = F.col("region_cos") * REGION_SHARE + F.col("color_cos") * COLOR_SHARE + overlap * SHARED_SHARE
    both = (F.col("size_a") > 0) & (F.col("size_b") > 0)
    return joined.select("a", "b", "shared", F.when(both, F.floor(score * 100 + 0.5)).otherwise(0).cast("long").alias("match"))


def friend_list(edges: DataFrame, users: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts.groupBy(F.col("user_id").alias("friend_id")).agg(F.count(F.lit(1)).alias("cards"))
    who = users.select(
        F.col("user_id").alias("friend_id"), display_name(F.col("display_name"), F.col("mail")).alias("name"),
        F.coalesce("cover_color", F.lit(DEFAULT_COVER)).alias("cover"))
    return both_ends(edges).join(who, "friend_id", "left").join(counts, "friend_id", "left").select(
        "user_id", "friend_id", "name", "cover", F.coalesce("cards", F.lit(0)).alias("cards"), F.col("created_at").alias("since"))


def accept_invites(accepts: DataFrame, invites: DataFrame, existing: DataFrame) -> DataFrame:
    """invalid, self, already or ok for each accepted code; ok once per pair, stored smaller id first."""
    clean = accepts.withColumn("code", F.upper(F.trim(F.coalesce("code", F.lit("")))))
    joined = clean.join(invites.select("code", F.col("user_id").alias("other")), "code", "left").withColumns(
        {"a": F.least("user_id", "other"), "b": F.greatest("user_id", "other")})
    real = joined.where(F.col("other").isNotNull() & (F.col("other") != F.col("user_id")))
    at = F.struct("ts", "event_id")
    firsts = real.groupBy("a", "b").agg(F.min(at).alias("first")).join(existing.select("a", "b"), ["a", "b"], "left_anti")
    return joined.join(firsts, ["a", "b"], "left").withColumn(
        "status",
        F.when(F.col("other").isNull(), "invalid").when(F.col("other") == F.col("user_id"), "self")
        .when(F.col("first") == at, "ok").otherwise("already")).drop("first")


def visible_albums(viewer_edges: DataFrame, albums: DataFrame) -> DataFrame:
    """Album pages per viewer, friends only; anything private was dropped before nesting."""
    return both_ends(viewer_edges).select(F.col("user_id").alias("viewer_id"), F.col("friend_id").alias("user_id")).join(albums, "user_id")


def friend_album(requests: DataFrame, edges: DataFrame, users: DataFrame, facts: DataFrame, page_items: DataFrame) -> DataFrame:
    """Who may see whose album, with the owner's profile and decorated pages; else not_friends.

    The cards themselves come as pages from `ranking.album_pages`; here is one row per request.
    """
    allowed = both_ends(edges).select(F.col("user_id").alias("viewer_id"), F.col("friend_id").alias("owner_id"))
    counts = facts.groupBy(F.col("user_id").alias("owner_id")).agg(F.count(F.lit(1)).alias("cards"))
    # a person decorates as many pages as there are sets and chapters, whatever they collect
    pages = page_items.groupBy(F.col("user_id").alias("owner_id")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("page", "items")))).alias("stickers"))
    profile = users.select(
        F.col("user_id").alias("owner_id"), display_name(F.col("display_name"), F.col("mail")).alias("name"),
        F.coalesce("cover_color", F.lit(DEFAULT_COVER)).alias("cover"))
    full = profile.join(counts, "owner_id", "left").join(pages, "owner_id", "left")
    seen = requests.join(allowed.withColumn("ok", F.lit(True)), ["viewer_id", "owner_id"], "left").join(full, "owner_id", "left")

    def if_ok(c: Column) -> Column:
        return F.when(F.col("ok"), c)

    return seen.select(
        *requests.columns, F.when(F.col("ok"), "ok").otherwise("not_friends").alias("status"), if_ok(F.col("name")).alias("name"),
        if_ok(F.col("cover")).alias("cover"), if_ok(F.coalesce("cards", F.lit(0))).alias("cards"), if_ok(F.col("stickers")).alias("stickers"))
