"""Ledgers against one-event-at-a-time replays, with a hot person and clock-change days."""

import datetime as dt
import random
from collections import defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from curatorium.operators import ledger
from curatorium.functions import chance

ZONE = ZoneInfo("Europe/Amsterdam")
UTC = dt.timezone.utc


def local_day(ts):
    return ts.replace(tzinfo=UTC).astimezone(ZONE).date()


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(11)
    start = dt.datetime(2024, 3, 29, 20, 0)   # the clocks change on the 31st
    stamps = sorted(rnd.sample(range(6 * 24 * 3600), 500))
    return [(i, start + dt.timedelta(seconds=s), 1 if rnd.random() < 0.5 else rnd.randrange(2, 9), rnd.randrange(12)) for i, s in enumerate(stamps)]


@pytest.fixture(scope="module")
def limits():
    return {1: 4, 2: 1, 3: 2, 5: 500}


@pytest.fixture(scope="module")
def frames(spark, log, limits):
    return (spark.createDataFrame(log, "event_id long, ts timestamp_ntz, user_id long, item_id long"),
            spark.createDataFrame(list(limits.items()), "user_id long, daily_limit int"))


def statuses(df):
    return {r.event_id: r.status for r in df.collect()}


def test_quota(frames, log, limits):
    used, want = defaultdict(int), {}
    for e, ts, u, _ in log:
        ok = used[u, local_day(ts)] < limits.get(u, 3)
        used[u, local_day(ts)] += 1
        want[e] = "ok" if ok else "limit"
    assert statuses(ledger.daily_quota(*frames)) == want


def test_admission(spark, frames, log, limits):
    owned, used, want = {(2, 3)}, defaultdict(int), {}
    for e, ts, u, i in log:
        key = (u, local_day(ts))
        if (u, i) in owned:
            want[e] = "duplicate"
        elif used[key] >= limits.get(u, 3):
            want[e] = "limit"
        else:
            want[e] = "new"
            owned.add((u, i))
            used[key] += 1
    had = spark.createDataFrame([(2, 3)], "user_id long, item_id long")
    assert statuses(ledger.admission(*frames, owned=had)) == want
    assert set(want.values()) == {"new", "duplicate", "limit"}


def test_repeats(frames, log, limits):
    cards, repeats = [], []
    seen = set()
    for row in log:
        if (row[2], row[3]) not in seen and row[0] % 3 == 0:
            seen.add((row[2], row[3]))
            cards.append(row)
        else:
            repeats.append(row)
    acquired, done, used, want = {}, set(), defaultdict(int), {}
    for e, ts, u, i in log:
        day = local_day(ts)
        if (e, ts, u, i) in cards:
            acquired[u, i] = day
            used[u, day] += 1
            continue
        if (u, i) not in acquired:
            want[e] = "no_card"
        elif acquired[u, i] == day or (u, i, day) in done:
            want[e] = "cooldown"
        elif used[u, day] >= limits.get(u, 3):
            want[e] = "limit"
        else:
            want[e] = "bottle"
            done.add((u, i, day))
            used[u, day] += 1
    spark = frames[0].sparkSession
    schema = "event_id long, ts timestamp_ntz, user_id long, item_id long"
    got = statuses(ledger.repeats(spark.createDataFrame(repeats, schema), spark.createDataFrame(cards, schema), frames[1]))
    assert got == want


@pytest.mark.parametrize("month_cap", [1, 60, 150, 10_000])
def test_caps(frames, log, limits, month_cap):
    month, used, want = defaultdict(int), defaultdict(int), {}
    for e, ts, u, _ in log:
        day = local_day(ts)
        cap = max(6, limits.get(u, 3) * 5)
        if month[day.strftime("%Y-%m")] >= month_cap:
            want[e] = "month_cap"
        elif used[u, day] >= cap:
            want[e] = "day_cap"
        else:
            want[e] = "ok"
            month[day.strftime("%Y-%m")] += 1
            used[u, day] += 1
    assert statuses(ledger.capped(*frames, month_cap=month_cap, day_cap=6, parts=5)) == want


def test_guarantee(spark):
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i) for i, u in enumerate([1] * 700 + [2] * 60)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")
    key = F.concat(F.lit("x"), F.col("event_id").cast("string"))
    drawn = {r.event_id: r.d for r in df.select("event_id", chance.draw_tier(key).alias("d")).collect()}
    got = {r.event_id: (r.tier, r.since_ultra, r.since_superrare) for r in ledger.guarantee(df, key, parts=8).collect()}
    for user in (1, 2):
        su = ss = 0
        for u, _, e in rows:
            if u != user:
                continue
            tier = "ultra" if su >= 99 else "superrare" if ss >= 24 else drawn[e]
            su = 0 if tier == "ultra" else su + 1
            ss = 0 if tier in ("ultra", "superrare") else ss + 1
            assert got[e] == (tier, su, ss)


def test_favourites(spark):
    rnd = random.Random(5)
    ops = [(1 if rnd.random() < 0.8 else 2, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, rnd.randrange(18), rnd.randrange(11)) for i in range(400)]
    df = spark.createDataFrame(ops, "user_id long, ts timestamp_ntz, event_id long, card long, rank long")
    got = {r.event_id: r.favourites for r in ledger.ranked_insert(df, parts=7).collect()}
    ranks = {1: {}, 2: {}}
    for u, _, e, card, rank in ops:
        mine = ranks[u]
        mine.pop(card, None)
        if rank:
            for c in [c for c, r in mine.items() if r >= rank]:
                if mine[c] >= 10:
                    del mine[c]
                else:
                    mine[c] += 1
            mine[card] = rank
        kept = sorted(mine, key=lambda c: (mine[c], c))[:10]
        ranks[u] = {c: i for i, c in enumerate(kept, 1)}
        assert got[e] == ",".join(str(c) for c in kept)


def test_confirmations(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    m = lambda n: t0 + dt.timedelta(minutes=n)
    pending = [(1, m(0), 1, 2000), (1, m(20), 5, None), (2, m(0), 20, 1999)]
    confirms = [(1, m(-1), 0, None), (1, m(1), 2, 1998), (1, m(2), 3, 2000), (1, m(3), 4, 2000), (1, m(26), 6, 2001), (1, m(25), 7, 2001), (2, m(4), 21, None)]
    schema = "user_id long, ts timestamp_ntz, event_id long, year int"
    got = statuses(ledger.confirm_within(spark.createDataFrame(pending, schema), spark.createDataFrame(confirms, schema), parts=4))
    assert got == {0: "back_expired", 2: "back_failed", 3: "ok", 4: "back_expired", 6: "back_expired", 7: "ok", 21: "ok"}


def test_stream_equals_batch(spark, frames, tmp_path):
    """Micro-batches out of order give the batch ledger's answers; a row of yesterday that comes today is late and moves no count."""
    from curatorium.streaming import ledger as stream_ledger, queries, replay

    rows, limit_rows = frames
    last = rows.agg(F.max("ts")).first()[0]
    extra = spark.createDataFrame([(1, 3, last - dt.timedelta(days=1), 2000), (-1, 0, last + dt.timedelta(days=900), -1)],
                                  "user_id long, item_id long, ts timestamp_ntz, event_id long")

    def save(frame):
        frame.select("event_id", "ts", "user_id", F.lit("scan").alias("event_type"), F.lit(0.0).alias("value"),
                     F.concat(F.lit('{"k": '), F.col("item_id").cast("string"), F.lit("}")).alias("props")
                     ).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))

    moments = sorted(r["ts"] for r in rows.select("ts").collect())
    cuts = [moments[len(moments) * n // 10] for n in (3, 7)]
    part = F.when(F.col("ts") < cuts[0], 0).when(F.col("ts") < cuts[1], 1).otherwise(2)
    for n in range(3):
        save(rows.where(part == n).orderBy(F.rand(n)))
    for one in (-1, 2000):
        save(extra.where(F.col("event_id") == one))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = queries.read_events(spark, str(tmp_path / "events"), files_per_batch=1)
        got = queries.run_to_table(stream_ledger.admission(stream, limit_rows), str(tmp_path / "run"))
        log = rows.select("event_id").union(extra.where("event_id = 2000").select("event_id"))
        assert statuses(replay.with_late(log, got)) == statuses(ledger.admission(rows, limit_rows)) | {2000: "late"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
