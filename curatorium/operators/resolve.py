"""Entity resolution: normalise, block, pick leaders, merge items and their facts.

Inside a block (equal normalised name and maker) a blank colour is compatible with every colour.
Processing rows oldest first and skipping the already merged has a closed form:

* the block's first row has no colour: it absorbs the whole block;
* otherwise the survivors are the first row of each colour; a coloured row goes to its colour's
  first row and a colourless row to the oldest survivor, the block's first row.

So two grouped minima replace all pairwise comparison: no self join, no pairs within a block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from curatorium.functions.text import natural_key, norm_name
from curatorium.functions.tiers import tier_name, tier_rank
from curatorium.operators.bounded import shuffled
from curatorium.operators.components import components
from curatorium.session import cut_lineage

MIN_NORM = 3


def with_block(items: DataFrame) -> DataFrame:
    return items.withColumns({
        "norm_name": norm_name(F.col("name")),
        "norm_maker": norm_name(F.col("maker")),
        "norm_color": F.lower(F.trim(F.coalesce(F.col("color"), F.lit("")))),
    })


def blocked(items: DataFrame) -> DataFrame:
    return with_block(items).where((F.length("norm_name") >= MIN_NORM) & (F.col("norm_maker") != ""))


def leaders(items: DataFrame) -> DataFrame:
    """item_id -> leader_id for every item that may be compared; a survivor leads itself."""
    block = ["norm_name", "norm_maker"]
    rows = blocked(items).select("item_id", "created_at", *block, "norm_color")
    age = F.struct("created_at", "item_id")
    # one grouped pass: the first row per colour, from which the block's first row follows
    colors = rows.groupBy(*block, "norm_color").agg(F.min(age).alias("first"))
    firsts = colors.groupBy(*block).agg(
        F.min("first.created_at").alias("_t"), F.min(F.struct("first", "norm_color")).alias("head")
    ).select(*block, F.col("head.first").alias("block_first"), F.col("head.norm_color").alias("block_color"))
    target = colors.join(shuffled(firsts), block).select(
        *block, "norm_color",
        F.when((F.col("block_color") == "") | (F.col("norm_color") == ""), F.col("block_first.item_id"))
        .otherwise(F.col("first.item_id")).alias("leader_id"),
    )
    # null never equals null in a join, and none of the keys can be null here
    return rows.join(shuffled(target), [*block, "norm_color"]).select("item_id", "leader_id")


def duplicate_pairs(items: DataFrame) -> DataFrame:
    """The (keep, drop) pairs a sequential merge would perform, one per dropped item."""
    return leaders(items).where("item_id <> leader_id").select(
        F.col("leader_id").alias("keep_id"), F.col("item_id").alias("drop_id")
    )


def block_statistics(items: DataFrame) -> DataFrame:
    """How many pairs each block would compare as equal, counted without forming them."""
    per_color = blocked(items).groupBy("norm_name", "norm_maker", "norm_color").agg(F.count(F.lit(1)).alias("n"))
    n, blank = F.col("n"), F.col("norm_color") == ""
    return (
        per_color.groupBy("norm_name", "norm_maker").agg(
            F.sum("n").alias("items"),
            F.sum(F.when(blank, n).otherwise(0)).alias("_blank"),
            F.sum(n * (n - 1)).alias("_same"),
        )
        # same colour pairs, plus every blank row with every coloured one
        .withColumn("pairs", (F.col("_same") / 2).cast("long") + F.col("_blank") * (F.col("items") - F.col("_blank")))
        .where("items > 1").select("norm_name", "norm_maker", "items", "pairs")
    )


def lookup_two_stage(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """item by exact key, else the oldest with the same normalised name and maker and a compatible colour."""
    # one row per key and colour on the item side, so a hot key on the attempt side is not multiplied
    exact = items.select(natural_key(F.col("maker"), F.col("name")).alias("k"), "item_id", "created_at").groupBy("k").agg(
        F.min_by("item_id", F.struct("created_at", "item_id")).alias("exact_id"))
    first = F.min(F.struct("created_at", "item_id"))
    block = ["norm_name", "norm_maker"]
    per_color = blocked(items).groupBy(*block, "norm_color").agg(first.alias("same"))
    per_block = per_color.groupBy(*block).agg(
        F.min("same").alias("any"), F.min(F.when(F.col("norm_color") == "", F.col("same"))).alias("blank"))
    wanted = with_block(attempts).withColumn("k", natural_key(F.col("maker"), F.col("name")))
    joined = wanted.join(exact, "k", "left").join(per_block, block, "left").join(per_color, [*block, "norm_color"], "left")
    found = F.when(F.col("norm_color") == "", F.col("any")).otherwise(F.least("same", "blank"))
    return joined.withColumns({
        "item_id": F.coalesce("exact_id", found["item_id"]),
        "stage": F.when(F.col("exact_id").isNotNull(), "exact").when(found.isNotNull(), "norm").otherwise("new"),
    }).drop("k", "exact_id", "same", "any", "blank")


def merge_survivors(items: DataFrame) -> DataFrame:
    """One record per leader that absorbed others, with the fields that win, as if the pairs were merged one by one, by the age of
    the item that goes. A merge whose new key another item has at that moment is refused: only the label is taken over.

    Groups whose keys nobody else ever holds or claims are merged in one step: "first non-empty" and "longest, earliest
    on ties" are grouped minima. The others are replayed merge by merge, together with those they compete with.
    """
    pairs = cut_lineage(leaders(items))
    if "signals" not in items.columns:
        items = items.withColumn("signals", F.lit(None).cast("string"))
    contested = cut_lineage(_contested(items, pairs))
    free = pairs.join(shuffled(contested.select("leader_id").distinct()), "leader_id", "left_anti")
    return _merged_at_once(items, free).unionByName(_replayed(items, contested))


def _contested(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader_id, item_id, claim, component, until, never) of the groups whose result depends on the order of merges.

    A row's claim is the key its group would take with this row's name. It is contested if an item other than the leader and the
    row holds it, or another group claims it. Groups that claim one key are a component; what else holds the key goes
    at a known moment, that of its own merge (`until`), or stays (`never`)."""
    keyed = items.select("item_id", "name", "maker", "created_at", natural_key(F.col("maker"), F.col("name")).alias("held"))
    sizes = pairs.groupBy("leader_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leader_id")
    own = keyed.join(shuffled(pairs.join(shuffled(sizes), "leader_id")), "item_id")
    heads = own.where("item_id = leader_id").select("leader_id", F.col("maker").alias("_maker"), F.col("held").alias("_head"))
    rows = own.join(shuffled(heads), "leader_id").withColumn("claim", natural_key(F.col("_maker"), F.col("name")))
    holders = keyed.groupBy(F.col("held").alias("claim")).agg(F.count(F.lit(1)).alias("holders"))
    claims = rows.groupBy("claim").agg(F.min("leader_id").alias("least"), F.max("leader_id").alias("most"))
    theirs = F.when(F.col("_head") == F.col("claim"), 1).otherwise(0) + F.when(
        (F.col("held") == F.col("claim")) & (F.col("item_id") != F.col("leader_id")), 1).otherwise(0)
    judged = rows.join(shuffled(claims), "claim").join(shuffled(holders), "claim", "left").withColumn(
        "clash", (F.coalesce("holders", F.lit(0)) > theirs) | (F.col("least") != F.col("most")))
    wild = judged.groupBy("leader_id").agg(F.bool_or("clash").alias("clash")).where("clash").select("leader_id")
    judged = cut_lineage(judged.join(shuffled(wild), "leader_id").select("leader_id", "item_id", "claim", "least"))
    joined = components(judged.select(F.col("leader_id").alias("a"), F.col("least").alias("b")))
    named = judged.drop("least").join(shuffled(joined.withColumnRenamed("node", "leader_id")), "leader_id", "left").withColumn(
        "component", F.coalesce("component", "leader_id"))
    dropped = pairs.where("item_id <> leader_id").select("item_id", F.lit(True).alias("goes"))
    of = named.select("claim", "component").distinct()
    inside = named.select("item_id", F.col("component").alias("_own"))
    others = keyed.withColumnRenamed("held", "claim").join(shuffled(of), "claim").join(shuffled(inside), "item_id", "left").where(
        ~F.col("_own").eqNullSafe(F.col("component"))).join(shuffled(dropped), "item_id", "left")
    outside = others.groupBy("claim").agg(
        F.max(F.when(F.col("goes"), F.struct("created_at", "item_id"))).alias("until"), F.bool_or(F.col("goes").isNull()).alias("never"))
    return named.join(shuffled(outside), "claim", "left").withColumn("never", F.coalesce("never", F.lit(False)))


_FIELDS = ("tier", "tier_reason", "first_user", "year", "signals")


def _replay(frame: pd.DataFrame) -> pd.DataFrame:
    """The merges of one component, in order; its rows compete for keys, so they must meet."""
    def known(v):
        return None if v is None or v is pd.NaT or v != v else v

    rows = [{k: known(v) for k, v in zip(frame.columns, r)} for r in frame.itertuples(index=False, name=None)]
    age = lambda at, item: (at is not None, at, item)
    state = {r["item_id"]: dict(r, refused=False, absorbed=0) for r in rows if r["item_id"] == r["leader_id"]}
    outside = {r["claim"]: (r["never"], age(r["until_at"], r["until_id"]) if r["until_id"] is not None else None) for r in rows}
    claim_of = {(r["leader_id"], r["name"]): r["claim"] for r in rows}
    holders: dict[str, int] = {}
    for r in rows:
        holders[r["held"]] = holders.get(r["held"], 0) + 1
    for d in sorted((r for r in rows if r["item_id"] != r["leader_id"]), key=lambda r: age(r["created_at"], r["item_id"])):
        k = state[d["leader_id"]]
        k["absorbed"] += 1
        if not k["label_locked"] and d["label_style"] is not None and (
                d["label_version"] == 2 or k["label_style"] is None or d["label_locked"]):
            k |= {c: d[c] for c in ("label_style", "label_version", "label_locked")}
        longer = len(d["name"] or "") > len(k["name"] or "")
        name = k["name"] if k["is_icon"] else d["name"] if d["is_icon"] or longer else k["name"]
        holders[d["held"]] -= 1
        claim, now = claim_of[k["leader_id"], name], age(d["created_at"], d["item_id"])
        never, until = outside[claim]
        taken = holders.get(claim, 0) - (k["held"] == claim) > 0 or never or (until is not None and until > now)
        k["refused"] |= taken
        if not taken:
            holders[k["held"]] -= 1
            holders[claim] = holders.get(claim, 0) + 1
            k |= {"name": name, "held": claim, "is_icon": bool(k["is_icon"] or d["is_icon"])}
            k |= {c: d[c] for c in _FIELDS if k[c] is None}
    out = [{"item_id": k["item_id"], "name": k["name"], **{c: k[c] for c in _FIELDS}, "is_icon": bool(k["is_icon"]),
            "label_style": k["label_style"], "key_taken": bool(k["refused"]), "absorbed": k["absorbed"]} for k in state.values()]
    return pd.DataFrame(out).astype({c: "object" for c in ("tier", "tier_reason", "first_user", "year", "signals", "label_style")})


def _replayed(items: DataFrame, contested: DataFrame) -> DataFrame:
    columns = ["item_id", "name", "created_at", *_FIELDS, "is_icon", "label_style", "label_version", "label_locked"]
    rows = items.select(*columns, natural_key(F.col("maker"), F.col("name")).alias("held")).join(shuffled(contested), "item_id").select(
        *columns, "held", "leader_id", "claim", "component", F.col("until.created_at").alias("until_at"), F.col("until.item_id").alias("until_id"), "never")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join([*[f"{c} {kinds[c]}" for c in ("item_id", "name", *_FIELDS)], "is_icon boolean", f"label_style {kinds['label_style']}",
                     "key_taken boolean", "absorbed bigint"])
    return rows.groupBy("component").applyInPandas(_replay, out)


def _merged_at_once(items: DataFrame, pairs: DataFrame) -> DataFrame:
    age = F.struct("created_at", "item_id")
    own = F.col("item_id") == F.col("leader_id")
    # the leader first, then the dropped by age
    turn = F.struct((~own).alias("later"), "created_at", "item_id")
    rows = items.join(shuffled(pairs), "item_id").withColumn("turn", turn)

    def first_known(name: str):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("turn"))).alias(name)

    icon = F.coalesce(F.col("is_icon"), F.lit(False))
    name_order = F.struct((~icon).alias("plain"), F.when(icon, F.lit(0)).otherwise(-F.length("name")).alias("len"), "turn")
    # a locked label ends the search, the leader's own first; else the newest drawn (v2) one replaces it
    dropped_label = ~own & F.col("label_style").isNotNull()
    locked = F.coalesce(F.col("label_locked"), F.lit(False))
    merged = rows.groupBy("leader_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by("name", name_order).alias("new_name"),
        *[first_known(c) for c in _FIELDS],
        F.max(F.when(own, F.col("label_style"))).alias("own_label"),
        F.bool_or(own & locked).alias("own_locked"),
        F.min_by("label_style", F.when(dropped_label & locked, age)).alias("first_locked"),
        F.max_by("label_style", F.when(dropped_label & (F.col("label_version") == 2), age)).alias("newest_drawn"),
        F.min_by("label_style", F.when(dropped_label, age)).alias("any_label"),
        F.bool_or(icon).alias("is_icon"),
    ).where("rows > 1")
    label = F.when(F.col("own_locked"), F.col("own_label")).otherwise(
        F.coalesce("first_locked", "newest_drawn", "own_label", "any_label"))
    return merged.select(
        F.col("leader_id").alias("item_id"), F.col("new_name").alias("name"), *_FIELDS, "is_icon", label.alias("label_style"),
        F.lit(False).alias("key_taken"), (F.col("rows") - 1).alias("absorbed"))


def merge_facts(facts: DataFrame, pairs: DataFrame, given_tier: DataFrame | None = None) -> DataFrame:
    """Re-key facts to the leader and combine those one person had twice.

    `given_tier` (item_id, given) is the tier the merged item prescribes; without one the
    highest tier wins. All other columns stay those of the leader's own fact, or of the oldest moved one without it.
    """
    leaders_too = pairs.select("keep_id", F.col("keep_id").alias("drop_id")).distinct()
    target = pairs.unionByName(leaders_too).select(F.col("drop_id").alias("item_id"), F.col("keep_id").alias("target_id"))
    joined = facts.join(target, "item_id", "left")
    columns = facts.columns
    kept = [c for c in columns if c not in ("user_id", "item_id", "fact_id", "bottles", "tier", "full_art", "memo", "created_at")]
    # facts of items outside any merge, nearly all of them, are passed on without a shuffle
    untouched = joined.where(F.col("target_id").isNull()).withColumn("bottles", F.coalesce("bottles", F.lit(1))).select(*columns)
    dropped = F.col("item_id") != F.col("target_id")
    moved = joined.where(F.col("target_id").isNotNull()).withColumns(
        {"dropped": dropped, "turn": F.struct(dropped.alias("d"), "created_at", "fact_id")})
    out = moved.groupBy("user_id", "target_id").agg(
        F.min_by(F.struct("fact_id", *kept), "turn").alias("_own"),
        F.sum(F.coalesce("bottles", F.lit(1))).alias("bottles"),
        F.max(tier_rank(F.col("tier"))).alias("rank"),
        F.bool_or("full_art").alias("full_art"),
        F.min_by("memo", F.when(F.col("memo").isNotNull(), F.col("turn"))).alias("memo"),
        F.min("created_at").alias("created_at"),
        F.bool_or("dropped").alias("touched"),
    ).withColumnRenamed("target_id", "item_id").select("*", "_own.*").drop("_own")
    tier = tier_name(F.col("rank"))
    if given_tier is not None:
        out = out.join(given_tier, "item_id", "left")
        tier = F.when(F.col("touched"), F.coalesce(F.col("given"), tier)).otherwise(tier)
    return untouched.unionByName(out.withColumn("tier", tier).select(*columns))


def given_tiers(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tier a merged item prescribes to its facts: icon, else the first known override or tier."""
    ids = pairs.select(F.col("keep_id").alias("lead"), F.col("drop_id").alias("item_id")).unionByName(
        pairs.select(F.col("keep_id").alias("lead"), F.col("keep_id").alias("item_id")).distinct())
    rows = items.join(ids, "item_id").withColumns({
        "known": F.coalesce("tier_override", "tier"),
        "turn": F.struct((F.col("item_id") != F.col("lead")).alias("later"), "created_at", "item_id"),
    })
    return rows.groupBy(F.col("lead").alias("item_id")).agg(
        F.when(F.bool_or(F.coalesce("is_icon", F.lit(False))), F.lit("icon"))
        .otherwise(F.min_by("known", F.when(F.col("known").isNotNull(), F.col("turn")))).alias("given"))


def merge_audit(facts: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One log row per dropped item: names and the number of facts that move."""
    counts = facts.groupBy(F.col("item_id").alias("drop_id")).agg(F.count(F.lit(1)).alias("cards_moved"))
    names = items.select("item_id", "name")
    return (
        pairs.join(names.toDF("keep_id", "keep_name"), "keep_id").join(names.toDF("drop_id", "drop_name"), "drop_id")
        .join(counts, "drop_id", "left")
        .select("keep_id", "drop_id", F.concat_ws(" + ", "keep_name", "drop_name").alias("names"),
                F.coalesce("cards_moved", F.lit(0)).alias("cards_moved"))
    )


def first_user(events: DataFrame) -> DataFrame:
    """Who was first with each item."""
    return events.groupBy("item_id").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))
