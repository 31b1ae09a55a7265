"""Counts, costs and reports. Every grouped result is combined map-side before it is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from curatorium.functions import dates
from curatorium.functions.money import usage_cost
from curatorium.functions.text import host_of
from curatorium.functions.tiers import TIERS
from curatorium.operators.ordered import position

# ---- fixed values ----
SPINE_DAYS = 14
ACTIVE_WINDOWS = (7, 30)
SHOP_SUFFIX = ".nl"
CHAIN_SHOPS = (
    "ah.nl jumbo.com plus.nl lidl.nl aldi.nl dirk.nl coop.nl hoogvliet.com gall.nl mitra.nl dekamarkt.nl vomar.nl "
    "spar.nl drankdozijn.nl wijnvoordeel.nl"
).split()
CHAIN_COUNT = 10
UNRATED = "(nog niet beoordeeld)"
# ---- end of fixed values ----


def unpivot_row(df: DataFrame) -> DataFrame:
    """A one-row frame as (metric, value) rows in a single pass over its source."""
    pairs = ", ".join(f"'{c}', cast({c} as bigint)" for c in df.columns)
    return df.selectExpr(f"stack({len(df.columns)}, {pairs}) as (metric, value)")


def kpi_row(
    users: DataFrame, activity: DataFrame, facts: DataFrame, items: DataFrame, edges: DataFrame, feedback: DataFrame, as_of: str
) -> DataFrame:
    """The dashboard row. Distinct actives come from one "last seen" per person, so the activity
    log is grouped once and never expanded per distinct count."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def recent(ts: Column, days: int) -> Column:
        return F.count(F.when(dates.within_days(ts, now, days), 1))

    last_seen = activity.groupBy("user_id").agg(
        F.max("ts").alias("ts"), F.count(F.when(dates.in_month_of(F.col("ts"), now), 1)).alias("this_month"))
    owned = facts.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    frames = [
        users.agg(F.count(F.lit(1)).alias("users"), recent(F.col("created_at"), 7).alias("new7")),
        last_seen.agg(recent(F.col("ts"), 7).alias("active7"), recent(F.col("ts"), 30).alias("active30"),
                      F.sum("this_month").alias("month_recognitions")),
        facts.agg(F.count(F.lit(1)).alias("cards"), recent(F.col("created_at"), 7).alias("cards7")),
        items.join(owned, "item_id", "left_semi").agg(
            F.count(F.lit(1)).alias("items"), recent(F.col("created_at"), 7).alias("items7")),
        edges.agg(F.count(F.lit(1)).alias("friends")),
        feedback.agg(F.count(F.when(~F.col("handled"), 1)).alias("feedback_open")),
    ]
    names = [c for f in frames for c in f.columns]
    long = reduce(DataFrame.unionByName, [unpivot_row(f) for f in frames])
    return long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def daily_spine(as_of: str, days: int, logs: dict[str, DataFrame], zone: str = "UTC") -> DataFrame:
    """One row per day ending at as_of, zero where nothing happened; logs carry a `ts` column."""
    first = next(iter(logs.values()))
    today = F.to_date(F.lit(as_of))
    spine = first.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    for name, log in logs.items():
        inside = log.where((F.col("ts") >= F.date_sub(today, days).cast("timestamp_ntz"))
                           & (F.col("ts") < F.date_add(today, 2).cast("timestamp_ntz")))
        counts = inside.groupBy(dates.local_day(F.col("ts"), zone).alias("day")).agg(F.count(F.lit(1)).alias(name))
        spine = spine.join(counts, "day", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return spine


def cost_by_kind(usage: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    cost = usage_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("web_searches"))
    return usage.where(dates.in_month_of(F.col("created_at"), now)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(cost), 2).alias("usd"))


def tier_map(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per tier as a map; at most one entry per tier, whatever the group's size."""
    counts = facts.groupBy(*keys, "tier").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tier", "n")))).alias("tiers"))


def names_per_tier(items: DataFrame, per_line: int = 50, parts: int | None = None) -> DataFrame:
    """'name (reason)' lists per tier in tier order, cut into lines so no tier becomes one value."""
    rows = items.select(
        F.coalesce("tier", F.lit(UNRATED)).alias("tier"), "name", "item_id",
        F.concat("name", F.lit(" ("), F.coalesce("tier_reason", F.lit("-")), F.lit(")")).alias("entry"))
    numbered = position(rows, ["tier"], ["name", "item_id"], parts=parts)
    line = F.floor((F.col("position") - 1) / per_line).alias("line")
    lines = numbered.groupBy("tier", line).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "entry"))), lambda e: e["entry"]), "  |  ").alias("names"))
    return lines.withColumn("tier_order", F.array_position(F.lit([*TIERS, UNRATED]), F.col("tier")))


def host_count(urls: DataFrame, keys: list[str], url: str, suffix: str = SHOP_SUFFIX, chains=CHAIN_SHOPS) -> DataFrame:
    """Distinct shop hosts per key; any chain shop counts as 10, nothing found is unknown."""
    host = F.col("host")
    is_chain = reduce(lambda a, b: a | b, [(host == c) | host.endswith("." + c) for c in chains])
    # repeated hosts of a key disappear map-side, before the keys meet
    distinct = urls.withColumn("host", host_of(F.col(url))).groupBy(*keys, "host").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(*keys).agg(
        F.max(F.when(is_chain, CHAIN_COUNT)).alias("_chain"), F.count(F.when(host.endswith(suffix), 1)).alias("_shops")
    ).select(*keys, F.coalesce("_chain", F.nullif(F.col("_shops"), F.lit(0))).alias("shops"))


def country_heat(facts: DataFrame) -> DataFrame:
    """Count per country with the opacity it is drawn with."""
    counts = facts.where(F.col("country").isNotNull()).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    # one row per country by now, so the unpartitioned maximum is over a handful of rows
    top = F.max("n").over(Window.partitionBy())
    return counts.withColumn("opacity", 0.6 + 0.4 * F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(4), top)))


def rolling_active(events: DataFrame, days: int, name: str) -> DataFrame:
    """Distinct people in the trailing `days` days, for every day, without expanding events.

    A person's days of activity cover [day, day + days) each; cut at the next active day these
    stretches do not overlap, so +1 where one starts and -1 where it ends add up to the count.
    """
    active = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    # at most one row per calendar day and person
    nxt = F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))
    stretch = active.select("day", F.least(F.date_add("day", days), nxt).alias("end"))
    change = stretch.select(F.explode(F.array(
        F.struct(F.col("day").alias("day"), F.lit(1).alias("d")), F.struct(F.col("end").alias("day"), F.lit(-1).alias("d"))
    )).alias("c")).groupBy("c.day").agg(F.sum("c.d").alias("d"))
    # one row per calendar day from here on, from the log's first day to its last
    ends = events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    running = F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("day"))
    return spine.join(change, "day", "left").select("day", running.alias(name))


LOG_REGISTERS = 12  # standard error about 1.6 %


def daily_sketches(events: DataFrame) -> DataFrame:
    """(day, sketch): a HyperLogLog sketch of each day's people, to be kept as a table; a row of 4 KB a day whatever the traffic."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(LOG_REGISTERS)).alias("sketch"))


def active_from_sketches(sketches: DataFrame, windows: tuple[int, ...] = ACTIVE_WINDOWS) -> DataFrame:
    """(day, about7, about30, ...): people active in the window that ends with each day, by union of the days' sketches; the log is
    not read. Days from the first to the last one with a sketch."""
    days = sketches.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    served = sketches.select("day", "sketch", F.explode(F.sequence(F.lit(0), F.lit(max(windows) - 1))).alias("age")).select(
        F.date_add("day", F.col("age")).alias("day"), "age", "sketch")
    unions = served.groupBy("day").agg(*[
        F.hll_sketch_estimate(F.hll_union_agg(F.when(F.col("age") < w, F.col("sketch")))).alias(f"about{w}") for w in windows])
    return days.join(unions, "day", "left").select("day", *[F.coalesce(f"about{w}", F.lit(0)).alias(f"about{w}") for w in windows])
