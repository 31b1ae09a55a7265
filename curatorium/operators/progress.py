"""Rule catalogues: which slots an item fills, set progress, gaps, rewards and badges.

A slot rule is a conjunction in which missing fields match anything. Written as OR-with-null it
would be a nested loop. Instead each combination of given fields (a signature) turns a rule into
one composite key; an item offers one key per signature in use, and a single hash join finds all
slots it fills. Signatures are few whatever the number of rules or items.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions.dates import in_harvest
from curatorium.functions.text import natural_key, squash
from curatorium.operators.bounded import small_or_shuffled
from curatorium.operators.facts import both_ends
from curatorium.operators.ranking import MILESTONES

# ---- fixed values ----
SPARKLING, BUBBLES = "mousserend", "bubbels"
COLORS = ("rood", "wit", "rosé", "bubbels")
SHINY = ("superrare", "ultra", "icon")
# ---- end of fixed values ----

_EQUAL = ("region", "grape", "country", "style", "color", "key")
_SEP = "\u0001"


def style_tag(style: Column, color: Column) -> Column:
    return F.when(style == SPARKLING, F.lit(BUBBLES)).otherwise(F.nullif(color, F.lit("")))


def _rule_keys(slots: DataFrame) -> DataFrame:
    """One row per slot and listed appellation with its composite key."""
    r = F.col("rule")
    one = slots.withColumn("app", F.explode_outer(r["app"]))
    given = {**{f: r[f] for f in _EQUAL}, "app": F.col("app"), "tag": r["tag"]}
    signature = F.concat_ws(",", *[F.when(c.isNotNull(), F.lit(f)) for f, c in given.items()])
    return one.withColumns({
        "signature": signature, "rule_key": F.concat_ws(_SEP, signature, *given.values()), "has": r["has"],
    })


def _with_tags(base: Column) -> Column:
    return F.transform(F.array_distinct("tags"), lambda tag: F.concat_ws(_SEP, base, tag))


def _item_keys(items: DataFrame, signatures: list[str]) -> DataFrame:
    """One row per item and key it offers; items carry `tags`, an array."""
    field = {f: F.col(f) for f in _EQUAL if f != "key"} | {
        "key": natural_key(F.col("maker"), F.col("name")), "app": F.col("appellation")}
    keys = []
    for signature in signatures:
        names = [n for n in signature.split(",") if n]
        plain = [field[n] for n in names if n != "tag"]
        known = reduce(lambda a, b: a & b, [c.isNotNull() for c in plain], F.lit(True))
        base = F.concat_ws(_SEP, F.lit(signature), *plain)
        offered = _with_tags(base) if "tag" in names else F.array(base)
        keys.append(F.when(known, offered).otherwise(F.array().cast("array<string>")))
    return items.select("item_id", F.col("appellation"), F.explode(F.concat(*keys)).alias("rule_key"))


def slot_fill(items: DataFrame, slots: DataFrame) -> DataFrame:
    """(item_id, set_id, position, slot, part) for every slot an item fills, in any number of sets."""
    rules = _rule_keys(slots).select("set_id", "position", "slot", "part", "signature", "rule_key", "has")
    # at most one signature per combination of eight fields
    signatures = sorted(r["signature"] for r in rules.select("signature").distinct().collect())
    hit = _item_keys(items, signatures).join(small_or_shuffled(rules), "rule_key")
    squashed = squash(F.col("appellation"))
    has = F.col("has").isNull() | F.exists("has", lambda f: squashed.contains(f))
    return hit.where(has).select("item_id", "set_id", "position", "slot", "part")


def set_totals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("set_id", "unlock", "secret", "always").agg(F.count(F.lit(1)).alias("total"))


WORD = 63  # positions to a long


def _words(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if re.fullmatch(r"bits\d+", c)), key=lambda c: int(c[4:]))


def filled_sets(facts: DataFrame, fills: DataFrame, slots: DataFrame) -> DataFrame:
    """(user_id, set_id, bits0, bits1, ...): the filled positions of each set as bits, WORD to a column; owning ten of an item fills
    nothing extra. One pass over the facts, of which one row per person and set leaves a task."""
    words = (slots.agg(F.max("position")).first()[0] or 0) // WORD + 1
    bit = F.expr(f"shiftleft(1L, cast(position % {WORD} as int))")
    names = [f"bits{w}" for w in range(words)]
    per_item = fills.groupBy("item_id", "set_id").agg(
        *[F.coalesce(F.bit_or(F.when(F.floor(F.col("position") / WORD) == w, bit)), F.lit(0).cast("long")).alias(n) for w, n in enumerate(names)])
    return facts.select("user_id", "item_id").join(per_item, "item_id").groupBy("user_id", "set_id").agg(*[F.bit_or(n).alias(n) for n in names])


def set_totals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("set_id", "unlock", "secret", "always").agg(F.count(F.lit(1)).alias("total"))


def set_progress(filled: DataFrame, slots: DataFrame) -> DataFrame:
    """How many slots of a set a person has filled, of how many; the bits stay."""
    totals = small_or_shuffled(set_totals(slots).select("set_id", "total"))
    n = reduce(lambda a, b: a + b, [F.bit_count(w) for w in _words(filled)]).cast("long")
    return filled.withColumn("filled", n).join(totals, "set_id").withColumn("complete", F.col("filled") == F.col("total"))


def visible_sets(progress: DataFrame, users: DataFrame, slots: DataFrame) -> DataFrame:
    """Sets each person can see: always, prerequisite complete, or (without one) something in it. A complete set brings the sets
    it unlocks with it, so the progress is read once."""
    sets, words = set_totals(slots), _words(progress)
    always = [r["set_id"] for r in sets.where("always").select("set_id").collect()]
    unlocks = sets.where(F.col("unlock").isNotNull()).groupBy(F.col("unlock").alias("set_id")).agg(F.collect_list("set_id").alias("_opens"))
    own = F.struct("set_id", "filled", *words, F.lit(False).alias("opened"))

    def empty(set_id: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(set_id.alias("set_id"), zero.alias("filled"), *[zero.alias(w) for w in words], F.lit(True).alias("opened"))

    opened = F.transform(F.when(F.col("complete"), F.coalesce("_opens", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), empty)
    started = progress.join(small_or_shuffled(unlocks), "set_id", "left").select("user_id", F.explode(F.concat(F.array(own), opened)).alias("s")).select("user_id", "s.*")
    shown = users.select("user_id", F.explode(F.lit(always).cast("array<string>")).alias("_set")).select("user_id", empty(F.col("_set")).alias("s")).select("user_id", "s.*")
    merged = started.unionByName(shown).groupBy("user_id", "set_id").agg(
        F.max("filled").alias("filled"), *[F.bit_or(w).alias(w) for w in words], F.bool_or("opened").alias("opened"))
    return merged.join(small_or_shuffled(sets), "set_id").where(
        F.col("opened") | (F.col("unlock").isNull() & (F.col("filled") > 0))
    ).select("user_id", "set_id", "filled", "total", (F.col("filled") == F.col("total")).alias("complete"), *words)


def gap_guide(visible: DataFrame, slots: DataFrame) -> DataFrame:
    """Empty slots of the sets a person sees, with where to find something that fits: the guide's rows whose bit is not set."""
    guide = slots.select("set_id", "position", "slot", "difficulty", "guide.text", "guide.price", "guide.tip")
    words = _words(visible)
    bits = F.element_at(F.array(*words), (F.floor(F.col("position") / WORD) + 1).cast("int"))
    return visible.where("not complete").select("user_id", "set_id", *words).join(small_or_shuffled(guide), "set_id").where(
        bits.bitwiseAND(F.expr(f"shiftleft(1L, cast(position % {WORD} as int))")) == 0).drop(*words)


def leftovers(facts: DataFrame, fills: DataFrame) -> DataFrame:
    """Owned items that fit no region slot."""
    return facts.join(fills.where("part = 1").select("item_id").distinct(), "item_id", "left_anti")


def chapters(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("country").isNotNull()).groupBy("user_id", "country").agg(
        F.count(F.lit(1)).alias("items"), F.min("created_at").alias("first_at"))


def reward_metrics(
    users: DataFrame, facts: DataFrame, items: DataFrame, edges: DataFrame, visible: DataFrame, shared: DataFrame
) -> DataFrame:
    """One row of progress numbers per person, from one pass over the facts."""
    rows = facts.join(items.select("item_id", "country", F.col("style").alias("_style"), F.col("color").alias("_color")), "item_id")
    tag = style_tag(F.col("_style"), F.col("_color"))
    own = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cards"),
        # a set of country names: bounded by the countries there are, not by the cards
        F.size(F.collect_set("country")).alias("lands"),
        reduce(lambda a, b: a + b, [F.max(F.when(tag == c, 1).otherwise(0)) for c in COLORS]).alias("colors"),
        F.max(F.when(F.col("tier").isin(*SHINY), 1).otherwise(0)).alias("shiny"),
        F.count("memo").alias("memos"),
        F.count("fav_rank").alias("top"),
        F.max(F.when(in_harvest(F.col("created_at")), 1).otherwise(0)).alias("autumn"),
    )
    friends = both_ends(edges).groupBy("user_id").agg(F.count(F.lit(1)).alias("friends"))
    sets = visible.where("complete").groupBy("user_id").agg(F.count(F.lit(1)).alias("sets"))
    most = both_ends(shared).groupBy("user_id").agg(F.max("shared").alias("shared"))
    out = users.select("user_id")
    for part in (own, friends, sets, most):
        out = out.join(part, "user_id", "left")
    names = ("cards", "friends", "lands", "colors", "shiny", "memos", "top", "sets", "shared", "autumn")
    return out.select("user_id", *[F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in names])


def reward_progress(metrics: DataFrame, rewards: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c != "user_id"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = metrics.selectExpr("user_id", f"stack({len(names)}, {pairs}) as (metric, value)")
    return long.join(small_or_shuffled(rewards), "metric").select(
        "user_id", F.col("id").alias("reward"), F.least("value", "goal").alias("n"), "goal",
        (F.col("value") >= F.col("goal")).alias("ready"))


def due_rewards(progress: DataFrame, opened: DataFrame) -> DataFrame:
    return progress.where("ready").select("user_id", "reward").join(opened, ["user_id", "reward"], "left_anti")


def earned_badges(
    users: DataFrame, facts: DataFrame, items: DataFrame, visible: DataFrame, opened: DataFrame, rewards: DataFrame, basics: list[str]
) -> DataFrame:
    """All badges of a person as kind:name; the kinds do not overlap, so each is deduplicated on its own."""
    def badge(kind: str, value: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), value).alias("badge")

    rows = facts.join(items.select("item_id", "country", F.coalesce("region", "country").alias("place")), "item_id")
    lands = rows.where(F.col("country").isNotNull()).select("user_id", badge("v", F.col("country"))).distinct()
    special = rows.where("full_art").select("user_id", badge("h", F.col("place"))).distinct()
    counts = facts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    marks = counts.select("user_id", F.explode(F.filter(F.lit(list(MILESTONES)), lambda m: m <= F.col("n"))).alias("m")).select(
        "user_id", badge("m", F.col("m").cast("string")))
    sets = visible.where("complete").select("user_id", badge("e", F.col("set_id")))
    basic = users.select("user_id", F.explode(F.lit(basics)).alias("b")).select("user_id", badge("b", F.col("b")))
    packs = opened.join(small_or_shuffled(rewards.select(F.col("id").alias("reward"), "badges")), "reward").select(
        "user_id", F.explode("badges").alias("b")).select("user_id", badge("p", F.col("b")))
    # everything but basics needs at least one card; opened packs imply one
    return reduce(DataFrame.unionByName, [basic, lands, marks, sets, special, packs])


def icon_coverage(facts: DataFrame, items: DataFrame, rules: list[dict]) -> DataFrame:
    """(user_id, country, icon, legend, owned) for every icon, legends too, of each country a person has discovered. An icon is owned
    with any item whose maker and name fit it, wherever that comes from."""
    text = F.concat_ws(" ", "maker", "name")
    hits = F.filter(F.array(*[F.when(text.rlike("(?i)" + r["pattern"]), F.lit(r["country"] + _SEP + r["name"])) for r in rules]),
                    lambda x: x.isNotNull())
    matched = items.select("item_id", F.explode(hits).alias("key"))
    owned = facts.join(matched, "item_id").select("user_id", "key").distinct().withColumn("owned", F.lit(True))
    known = chapters(facts.join(items.select("item_id", "country"), "item_id")).select("user_id", "country")
    icons = items.sparkSession.createDataFrame(
        [(r["country"], r["name"], bool(r["legend"])) for r in rules], "country string, icon string, legend boolean")
    each = known.join(small_or_shuffled(icons), "country").withColumn("key", F.concat("country", F.lit(_SEP), "icon"))
    return each.join(owned, ["user_id", "key"], "left").select("user_id", "country", "icon", "legend", F.coalesce("owned", F.lit(False)).alias("owned"))
