"""Admissions, confirmations, caps and active people as keyed stateful streams, in event time order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from curatorium.functions.dates import HOME_ZONE, local_day
from curatorium.operators.ledger import CAP_PER_LIMIT, CONFIRM_MINUTES, DAY_CAP, DEFAULT_DAILY_LIMIT, MONTH_CAP
from curatorium.operators.ordered import first_k
from curatorium.streaming.replay import PACKED, OrderedReplay, packed, replayed, unpacked

DELAY = "2 hours"
ENTRIES = 16  # a person's owned items are put together after so many
_EPOCH = "1970-01-01"


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def _items(items) -> tuple[bytes]:
    values = np.array(sorted(items), np.int64)
    return (packed([values], [np.zeros(len(values), np.bool_)]),)


def _day(zone: str):
    return F.date_diff(local_day(F.col("ts"), zone), F.lit(_EPOCH).cast("date"))


def _limited(events: DataFrame, limits: DataFrame, zone: str) -> DataFrame:
    return events.join(limits.select("user_id", "daily_limit"), "user_id", "left").withColumns({
        "day": _day(zone), "daily_limit": F.coalesce("daily_limit", F.lit(DEFAULT_DAILY_LIMIT))})


class Admission(OrderedReplay):
    """new, duplicate or limit per attempt; keeps the day's count and the owned items."""

    columns = ("item_id", "day", "daily_limit")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.today = handle.getValueState("today", _longs("day", "used"))
        self.owned = handle.getListState("owned", PACKED)

    def drain(self, key: int, rows: list[tuple]) -> list[tuple]:
        today, used = (int(v) for v in self.today.get()) if self.today.exists() else (None, 0)
        entries = [bytes(e[0]) for e in self.owned.get()]
        owned = {item for e in entries for item, in unpacked(e, 1)}
        out, gained = [], []
        for _, event, item, day, limit in rows:
            used = used if day == today else 0
            today = day
            if item in owned:
                out.append((key, event, "duplicate", None))
            elif used >= limit:
                out.append((key, event, "limit", None))
            else:
                owned.add(item)
                gained.append(item)
                used += 1
                out.append((key, event, "new", None))
        if gained and len(entries) >= ENTRIES:
            self.owned.put([_items(owned)])
        elif gained:
            self.owned.appendValue(_items(gained))
        if rows:
            self.today.update((today, used))
        return out


def admission(attempts: DataFrame, limits: DataFrame, zone: str = HOME_ZONE, delay: str = DELAY, closing: DataFrame | None = None) -> DataFrame:
    """Streaming attempts (user_id, item_id, event_id, ts) joined with static limits."""
    return replayed(_limited(attempts.where("item_id is not null"), limits, zone), Admission(), delay, closing=closing)


class Confirmation(OrderedReplay):
    """ok, back_failed or back_expired per confirmation of the person's latest check; keeps that check and whether it is used up."""

    columns = ("is_check", "year")

    def __init__(self, minutes: int) -> None:
        self.open_ms = minutes * 60_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.check = handle.getValueState("check", _longs("at", "event", "year", "used"))

    def drain(self, key: int, rows: list[tuple]) -> list[tuple]:
        held = self.check.get() if self.check.exists() else None
        asked, check, known, used = (None if v is None else int(v) for v in held) if held else (None, None, None, 0)
        out = []
        for at, event, is_check, year in rows:
            if is_check:
                asked, check, known, used = at, event, year, 0
            elif check is None or at > asked + self.open_ms or used:
                out.append((key, event, "back_expired", check))
            elif year is not None and known is not None and year != known:
                out.append((key, event, "back_failed", check))
            else:
                used = 1
                out.append((key, event, "ok", check))
        if check is not None:
            self.check.update((asked, check, known, used))
        return out


def confirmations(events: DataFrame, minutes: int = CONFIRM_MINUTES, delay: str = DELAY, closing: DataFrame | None = None) -> DataFrame:
    """Streaming checks and confirmations (user_id, event_id, ts, is_check, year); one row per confirmation, `detail` its check."""
    return replayed(events, Confirmation(minutes), delay, closing=closing)


class DayCap(OrderedReplay):
    """Whether a call is among the person's first `cap` of the day (`detail` 1 or 0); keeps the day's count."""

    columns = ("day", "cap")
    output = ("user_id", "event_id", "at", "fine")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.today = handle.getValueState("today", _longs("day", "used"))

    def drain(self, key: int, rows: list[tuple]) -> list[tuple]:
        today, used = (int(v) for v in self.today.get()) if self.today.exists() else (None, 0)
        out = []
        for at, event, day, cap in rows:
            used = used if day == today else 0
            today = day
            out.append((key, event, at, used < cap))
            used += used < cap
        if rows:
            self.today.update((today, used))
        return out


def day_caps(calls: DataFrame, limits: DataFrame, day_cap: int = DAY_CAP, zone: str = HOME_ZONE, delay: str = DELAY) -> DataFrame:
    """First stage of the caps: (user_id, event_id, at, fine) for every call of the stream."""
    capped = _limited(calls, limits, zone).withColumn("cap", F.greatest(F.lit(day_cap), F.col("daily_limit") * CAP_PER_LIMIT))
    return replayed(capped, DayCap(), delay, "user_id long, event_id long, at long, fine boolean")


def hourly(fine: DataFrame, zone: str = HOME_ZONE) -> DataFrame:
    """Second stage, over the stream of the first one's rows: fine calls per month and hour, so that a month's rows are counted
    where they are and never meet."""
    stamp = F.timestamp_millis("at")
    return fine.where("fine").withColumns({"month": F.date_format(F.from_utc_timestamp(stamp, zone), "yyyy-MM"), "hour": F.floor(F.col("at") / 3_600_000)}).groupBy(
        "month", "hour").agg(F.count(F.lit(1)).alias("n"))


def month_caps(judged: DataFrame, hours: DataFrame, month_cap: int = MONTH_CAP, zone: str = HOME_ZONE) -> DataFrame:
    """(event_id, status) from both stages: the hour in which a month fills up follows from the counts, a row per month and hour;
    only that hour's rows are put in order, to find the call that was the last one."""
    upto = Window.partitionBy("month").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    # one row an hour: a month has 745 at most
    full = hours.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") >= month_cap) & (F.col("upto") - F.col("n") < month_cap)).select(
        "month", "hour", (F.lit(month_cap) - F.col("upto") + F.col("n")).alias("left"))
    stamp = F.timestamp_millis("at")
    rows = judged.withColumns({"month": F.date_format(F.from_utc_timestamp(stamp, zone), "yyyy-MM"), "hour": F.floor(F.col("at") / 3_600_000)})
    last = first_k(rows.where("fine").join(F.broadcast(full), ["month", "hour"]), ["month"], ["at", "event_id"], month_cap).where(
        "position = left").select("month", F.struct("at", "event_id").alias("cut"))
    out = rows.join(F.broadcast(last), "month", "left")
    return out.select("event_id", F.when(F.struct("at", "event_id") > F.col("cut"), "month_cap").when(F.col("fine"), "ok").otherwise("day_cap").alias("status"))


class Active(OrderedReplay):
    """Changes of the number of active people: a person counts on the `days` days after an active one. Keeps the last day that is
    covered already, so an active stretch gives +1 where it begins and -1 after its end."""

    columns = ("day",)
    output = ("day", "change")

    def __init__(self, days: int) -> None:
        self.days = days

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.covered = handle.getValueState("covered", _longs("day"))

    def drain(self, key: int, rows: list[tuple]) -> list[tuple]:
        covered = int(self.covered.get()[0]) if self.covered.exists() else -1 << 40
        out = []
        for day in sorted({r[2] for r in rows}):
            begin, end = max(day + 1, covered + 1), day + self.days
            if begin <= end:
                out += [(begin, 1), (end + 1, -1)]
                covered = end
        if out:
            self.covered.update((covered,))
        return out


def active_changes(events: DataFrame, days: int = 7, delay: str = DELAY) -> DataFrame:
    """(day, change) of the streaming events; days are numbers since 1970, in UTC."""
    return replayed(events.withColumn("day", F.floor(F.unix_millis("ts") / 86_400_000)), Active(days), delay, "day long, change long")


def active_people(changes: DataFrame) -> DataFrame:
    """(until, users): exact number of people active in the days before each day, a running sum over the changes of all days."""
    by_day = changes.groupBy("day").agg(F.sum("change").alias("change"))
    # one row a day; days without a change stand where the last one left them
    spine = by_day.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    total = F.sum(F.coalesce("change", F.lit(0))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return spine.join(by_day, "day", "left").select(F.date_add(F.lit(_EPOCH).cast("date"), F.col("day").cast("int")).alias("until"), total.alias("users"))
