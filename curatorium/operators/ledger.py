"""Quotas, cooldowns, caps and confirmations over event sequences.

The reference behaviour is "one event at a time per person". Each ledger is written in the form
that gives the same answer without putting a person's whole history into one task; see `ordered`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from curatorium.functions import chance, dates
from curatorium.functions.tiers import TIERS, tier_name, tier_rank
from curatorium.operators.ordered import Automaton, compose, first_k, fold, position, running
from curatorium.session import cut_lineage

# ---- fixed values: limits ----
DEFAULT_DAILY_LIMIT = 3
DAY_CAP, MONTH_CAP = 15, 20_000
CAP_PER_LIMIT = 5
ULTRA_AFTER, SUPERRARE_AFTER = 99, 24
CONFIRM_MINUTES = 5
MAX_FAVOURITES = 10
# ---- end of fixed values ----

WHEN = ["ts", "event_id"]


def _at() -> Column:
    return F.struct(*WHEN)


def _with_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    return rows.join(limits.select("user_id", "daily_limit"), "user_id", "left").withColumn(
        "daily_limit", F.coalesce("daily_limit", F.lit(DEFAULT_DAILY_LIMIT)))


def _widest(limits: DataFrame) -> int:
    """The highest limit given: more rows of a person and day than that can't matter."""
    return max(limits.agg(F.max("daily_limit")).first()[0] or 0, DEFAULT_DAILY_LIMIT)


def daily_quota(actions: DataFrame, limits: DataFrame, zone: str = dates.HOME_ZONE) -> DataFrame:
    """ok for the first n actions of a person and local day, limit after that."""
    rows = actions.withColumn("day", dates.local_day(F.col("ts"), zone))
    # each task keeps at most as many rows per person-day as the highest limit before the shuffle
    head = first_k(rows.select("user_id", "day", *WHEN), ["user_id", "day"], WHEN, _widest(limits))
    cut = _with_limit(head, limits).where("position <= daily_limit").groupBy("user_id", "day").agg(F.max(_at()).alias("cut"))
    return rows.join(cut, ["user_id", "day"], "left").withColumn(
        "status", F.when(_at() <= F.col("cut"), "ok").otherwise("limit")).drop("cut")


def _first_repeats(repeats: DataFrame, cards: DataFrame, zone: str) -> DataFrame:
    """Repeats with their local day, whether the item was theirs (and since an earlier day), and the
    day's first repeat of that item."""
    rows = repeats.withColumn("day", dates.local_day(F.col("ts"), zone))
    acquired = cards.groupBy("user_id", "item_id").agg(F.min("ts").alias("acquired"))
    firsts = rows.groupBy("user_id", "item_id", "day").agg(F.min(_at()).alias("first"))
    joined = rows.join(acquired, ["user_id", "item_id"], "left").join(firsts, ["user_id", "item_id", "day"])
    bought = dates.local_day(F.col("acquired"), zone)
    return joined.withColumns({
        "owned": F.coalesce(F.col("acquired") <= F.col("ts"), F.lit(False)),
        "owned_before_today": F.coalesce(F.col("day") > bought, F.lit(False)),
    }).drop("acquired")


def cooldown(repeats: DataFrame, cards: DataFrame, zone: str = dates.HOME_ZONE) -> DataFrame:
    """One repeat per person, item and local day, and none on the day the item was acquired."""
    return _first_repeats(repeats, cards, zone).withColumn(
        "status",
        F.when(~F.col("owned"), "no_card")
        .when(F.col("owned_before_today") & (_at() == F.col("first")), "bottle").otherwise("cooldown"),
    ).drop("first", "owned", "owned_before_today")


def admission(attempts: DataFrame, limits: DataFrame, owned: DataFrame | None = None, zone: str = dates.HOME_ZONE) -> DataFrame:
    """new, duplicate or limit for every attempt; only admitted items count and stay owned.

    Within a day the first `limit` not-yet-owned items, by first attempt, are admitted. What is
    owned depends on earlier days only, so repeating "rank what is not owned by then" from an
    optimistic start settles day by day and stops at the sequential answer, usually within a few
    rounds instead of one per day.
    """
    rows = attempts.withColumn("day", dates.local_day(F.col("ts"), zone))
    key = ["user_id", "item_id"]
    had = None if owned is None else owned.select(*key).distinct()
    fresh = rows if had is None else rows.join(had, key, "left_anti")
    candidates = cut_lineage(_with_limit(fresh.groupBy(*key, "day").agg(F.min(_at()).alias("first")), limits))
    admitted, widest = None, _widest(limits)
    while True:
        open_rows = candidates
        if admitted is not None:
            open_rows = candidates.join(admitted.select(*key, F.col("day").alias("since")), key, "left").where(
                F.col("since").isNull() | (F.col("day") <= F.col("since"))).drop("since")
        ranked = first_k(open_rows, ["user_id", "day"], ["first"], widest).where("position <= daily_limit")
        now = cut_lineage(ranked.groupBy(*key).agg(F.min(F.struct("day", "first")).alias("a")).select(*key, "a.day", "a.first"))
        if admitted is not None:
            # same size and no row of the one missing from the other: nothing moved in this round
            if now.count() == admitted.count() and now.join(admitted, [*key, "day"], "left_anti").isEmpty():
                break
        admitted = now
    out = rows.join(admitted.select(*key, "first"), key, "left")
    status = F.when(_at() == F.col("first"), "new").when(_at() > F.col("first"), "duplicate").otherwise("limit")
    if had is not None:
        out = out.join(had.withColumn("_had", F.lit(True)), key, "left")
        status = F.when(F.col("_had"), "duplicate").otherwise(status)
        out = out.withColumn("status", status).drop("_had", "first")
        return out
    return out.withColumn("status", status).drop("first")


def repeats(actions: DataFrame, cards: DataFrame, limits: DataFrame, zone: str = dates.HOME_ZONE) -> DataFrame:
    """no_card, cooldown, limit or bottle for every repeat.

    Cards and accepted repeats share the day's quota. Only the first repeat per item and day can be
    accepted, and of cards and such candidates together exactly the first `limit` of the day get
    through: as long as fewer came before, all of them were accepted.
    """
    checked = _first_repeats(actions, cards, zone)
    owned = cards.withColumn("day", dates.local_day(F.col("ts"), zone))
    candidates = checked.where(F.col("owned") & F.col("owned_before_today") & (_at() == F.col("first")))
    merged = candidates.select("user_id", "day", *WHEN).unionByName(owned.select("user_id", "day", *WHEN))
    head = first_k(merged, ["user_id", "day"], WHEN, _widest(limits))
    cut = _with_limit(head, limits).where("position <= daily_limit").groupBy("user_id", "day").agg(F.max(_at()).alias("cut"))
    # a refused first repeat does not start the cooldown: the quota is still what stops later ones
    accepted = F.coalesce(F.col("first") <= F.col("cut"), F.lit(False))
    return checked.join(cut, ["user_id", "day"], "left").withColumn(
        "status",
        F.when(~F.col("owned"), "no_card").when(~F.col("owned_before_today"), "cooldown").when(~accepted, "limit")
        .when(_at() == F.col("first"), "bottle").otherwise("cooldown"),
    ).drop("cut", "first", "owned", "owned_before_today")


def capped(calls: DataFrame, limits: DataFrame, month_cap: int = MONTH_CAP, day_cap: int = DAY_CAP, zone: str = dates.HOME_ZONE,
           parts: int | None = None) -> DataFrame:
    """ok, day_cap or month_cap for every call: the month's total is checked first, ok uses up both.

    Until the month is full, a call is ok if it is among the first `cap` of its person and day. The
    month is full at the month_cap-th such call; from there on everything is refused.
    """
    rows = calls.withColumns({"day": dates.local_day(F.col("ts"), zone), "month": dates.local_month(F.col("ts"), zone)})
    widest = max(day_cap, CAP_PER_LIMIT * _widest(limits))
    head = _with_limit(first_k(rows.select("user_id", "day", "month", *WHEN), ["user_id", "day"], WHEN, widest), limits)
    fine = head.where(F.col("position") <= F.greatest(F.lit(day_cap), F.col("daily_limit") * CAP_PER_LIMIT))
    day_cut = fine.groupBy("user_id", "day").agg(F.max(_at()).alias("day_cut"))
    month_cut = position(fine.select("month", *WHEN), ["month"], WHEN, "n", parts).where(F.col("n") == month_cap).select(
        "month", _at().alias("month_cut"))
    # one row per month
    out = rows.join(day_cut, ["user_id", "day"], "left").join(month_cut, "month", "left")
    return out.withColumn(
        "status",
        F.when(_at() > F.col("month_cut"), "month_cap").when(_at() <= F.col("day_cut"), "ok").otherwise("day_cap"),
    ).drop("day_cut", "month_cut")


class _Guarantee(Automaton):
    """Misses since the last ultra and since the last superrare or better. Counts from ULTRA_AFTER and SUPERRARE_AFTER on act
    alike, so a segment has (ULTRA_AFTER + 1) * (SUPERRARE_AFTER + 1) entries."""

    start = (0, 0)

    def entries(self, row: tuple) -> np.ndarray:
        return np.stack(np.meshgrid(np.arange(ULTRA_AFTER + 1), np.arange(SUPERRARE_AFTER + 1), indexing="ij"), -1).reshape(-1, 2)

    def advance(self, states: np.ndarray, row: tuple) -> np.ndarray:
        drawn, icon = row
        ultra, superrare = states[:, 0], states[:, 1]
        due = np.zeros(len(states), bool) if icon else ultra >= ULTRA_AFTER
        hit = due if icon else due | ((drawn == "ultra") & ~(superrare >= SUPERRARE_AFTER))
        any_hit = hit if icon else hit | (superrare >= SUPERRARE_AFTER) | (drawn == "superrare")
        return np.stack([np.where(hit, 0, ultra + 1), np.where(any_hit, 0, superrare + 1)], 1)

    def leave(self, entries: np.ndarray, ends: np.ndarray, state: tuple, rows: int) -> tuple:
        at = min(int(state[0]), ULTRA_AFTER) * (SUPERRARE_AFTER + 1) + min(int(state[1]), SUPERRARE_AFTER)
        # a counter that was never reset has grown by a row each, from where it really stood
        return tuple(int(own) + rows if end == entry + rows else int(end) for own, entry, end in zip(state, entries[at], ends[at]))

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        since_ultra, since_superrare = int(state[0]), int(state[1])
        drawn, icon = row
        if icon:
            drawn = "icon"
        elif since_ultra >= ULTRA_AFTER:
            drawn = "ultra"
        elif since_superrare >= SUPERRARE_AFTER:
            drawn = "superrare"
        since_ultra = 0 if drawn == "ultra" else since_ultra + 1
        since_superrare = 0 if drawn in ("ultra", "superrare") else since_superrare + 1
        return (since_ultra, since_superrare), (drawn, since_ultra, since_superrare)


def guarantee(draws: DataFrame, chance_key: Column, parts: int | None = None) -> DataFrame:
    """Random draws with a guaranteed ultra after 99 misses and superrare after 24. An icon item (`is_icon`, if there is such
    a column) is always drawn as icon; the counters go on."""
    icon = F.coalesce("is_icon", F.lit(False)) if "is_icon" in draws.columns else F.lit(False)
    return compose(
        draws, ["user_id"], WHEN, {"drawn": chance.draw_tier(chance_key), "icon": icon}, _Guarantee(),
        "tier string, since_ultra bigint, since_superrare bigint", parts)


def running_best(draws: DataFrame) -> DataFrame:
    """Upgrade-only tier per person and item: old value, drawn value, whether it went up.

    The scale has five steps, so "when was each step first reached" is a handful of grouped minima
    and no running window over a person's history is needed.
    """
    key = ["user_id", "item_id"]
    ranked = draws.withColumn("rank", tier_rank(F.col("drawn")))
    steps = range(2, len(TIERS) + 1)
    reached = ranked.groupBy(*key).agg(
        F.min(_at()).alias("_r1"), *[F.min(F.when(F.col("rank") >= s, _at())).alias(f"_r{s}") for s in steps])
    out = ranked.join(reached, key)
    before = F.when(F.col("_r1") < _at(), 1)
    for s in steps:
        before = F.when(F.col(f"_r{s}") < _at(), s).otherwise(before)
    return out.withColumn("_old", before).select(
        *draws.columns, tier_name(F.col("_old")).alias("old_tier"),
        tier_name(F.greatest("_old", "rank")).alias("tier"),
        (F.col("rank") > F.coalesce("_old", F.lit(0))).alias("upgraded"))


def confirm_within(pending: DataFrame, confirms: DataFrame, minutes: int = CONFIRM_MINUTES, parts: int | None = None) -> DataFrame:
    """Each confirmation against the person's latest pending check: ok, back_failed or back_expired.

    A check is used once, within its time, and years must agree when both are known. The latest
    check before a confirmation is a running maximum over both logs (an as-of join).
    """
    both = pending.select("user_id", *WHEN, "year", F.lit(True).alias("is_check")).unionByName(
        confirms.select("user_id", *WHEN, "year", F.lit(False).alias("is_check")))
    check = F.when(F.col("is_check"), F.struct("ts", "event_id", "year"))
    seen = running(both, ["user_id"], WHEN, {"check": ("max", check)}, parts).where(~F.col("is_check"))
    in_time = F.col("ts") <= F.col("check.ts") + F.expr(f"INTERVAL {minutes} MINUTES")
    years_agree = F.col("year").isNull() | F.col("check.year").isNull() | (F.col("year") == F.col("check.year"))
    rows = seen.withColumns({"check_id": F.col("check.event_id"), "in_time": F.coalesce(in_time, F.lit(False)), "agree": years_agree})
    used = rows.where("in_time and agree").groupBy("check_id").agg(F.min(_at()).alias("used_at"))
    return rows.join(used, "check_id", "left").select(
        "user_id", *WHEN, "check_id",
        F.when(F.col("used_at") == _at(), "ok")
        .when(~F.col("in_time") | (F.col("used_at") < _at()), "back_expired").otherwise("back_failed").alias("status"))


def _favourite_step(state: tuple, values: tuple) -> tuple[tuple, tuple]:
    card, rank = values
    if rank > 0:
        # those at or below the wanted rank move down, the tenth drops out; gaps close afterwards
        above = [c for i, c in enumerate(state, 1) if c != card and i < rank]
        below = [c for i, c in enumerate(state, 1) if c != card and rank <= i < MAX_FAVOURITES]
        state = (*above, card, *below)
    else:
        state = tuple(c for c in state if c != card)
    return state, (",".join(str(c) for c in state),)


def ranked_insert(operations: DataFrame, parts: int | None = None) -> DataFrame:
    """A top ten per person after every "put card at rank" (0 takes it out); the eleventh drops off."""
    return fold(
        operations, ["user_id"], WHEN, {"card": F.col("card"), "rank": F.col("rank")}, (), _favourite_step,
        "favourites string", parts)


def sticky_first(notes: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """The date a note was first written; rewriting keeps it, clearing (null text) resets it."""
    cleared = F.when(F.col("text").isNull(), F.struct(*WHEN))
    rows = running(notes, keys, WHEN, {"last_clear": ("max", cleared)}, parts)
    # a stretch between two clearings is named by the clearing before it
    firsts = rows.where(F.col("text").isNotNull()).groupBy(*keys, "last_clear").agg(F.min("ts").alias("written"))
    same = [F.col("r." + k) == F.col("f." + k) for k in keys] + [F.col("r.last_clear").eqNullSafe(F.col("f.last_clear"))]
    return rows.alias("r").join(firsts.alias("f"), same, "left").select(
        "r.*", F.when(F.col("r.text").isNotNull(), F.col("f.written")).alias("written_at")).drop("last_clear")
