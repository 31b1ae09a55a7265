"""Streams whose rows arrive out of order, in several micro-batches, against the batch answers; one person owns a third of the rows."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from curatorium.operators import ledger as batch
from curatorium.streaming import ledger, queries

START = dt.datetime(2024, 3, 28, 20, 0)  # the clocks change on the 31st, the month a day later
LIMITS = [(1, 4), (2, 1), (3, 2)]


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(21)
    moments = sorted(rnd.sample(range(9 * 24 * 3600), 900))
    return [(i, START + dt.timedelta(seconds=s), 1 if rnd.random() < 0.35 else rnd.randrange(2, 12), rnd.choice(["view", "click"]), rnd.randrange(30))
            for i, s in enumerate(moments)]


@pytest.fixture(scope="module")
def frames(spark, log):
    rows = spark.createDataFrame(log, "event_id long, ts timestamp_ntz, user_id long, event_type string, item_id long")
    return rows, spark.createDataFrame(LIMITS, "user_id long, daily_limit int")


def arriving(spark, log, folder, extra=()):
    """Three files, a row up to an hour later than its place; then rows of their own files, the last one closing everything."""
    rnd = random.Random(3)
    placed = sorted(log, key=lambda r: r[1] + dt.timedelta(seconds=rnd.randrange(3600)))
    parts = [placed[n * len(placed) // 3 : (n + 1) * len(placed) // 3] for n in range(3)]
    parts += [[e] for e in extra] + [[(-1, START + dt.timedelta(days=900), -1, "view", 0)]]
    for part in parts:
        rnd.shuffle(part)
        rows = [(e, ts, u, kind, 0.0, f'{{"k": {i}}}') for e, ts, u, kind, i in part]
        spark.createDataFrame(rows, queries.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return queries.read_events(spark, folder, files_per_batch=1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")  # fewer state stores to open a micro-batch
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def statuses(df):
    return {r["event_id"]: r["status"] for r in df.collect() if r["event_id"] >= 0}


def test_caps(spark, frames, log, rocks, tmp_path):
    stream = arriving(spark, log, str(tmp_path / "in"))
    judged = queries.run_to_table(ledger.day_caps(stream, frames[1], day_cap=6), str(tmp_path / "days"))
    again = spark.readStream.schema(judged.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "days/data"))
    hours = queries.run_counts(ledger.hourly(again), str(tmp_path / "hours"), ["month", "hour"])
    for month_cap in (1, 150, 10_000):
        got = statuses(ledger.month_caps(judged, hours, month_cap))
        assert got == statuses(batch.capped(*frames, month_cap=month_cap, day_cap=6))


def test_confirmations(spark, frames, log, rocks, tmp_path):
    year = F.when(F.col("item_id") % 3 != 0, 1990 + F.col("item_id") % 2)
    stream = arriving(spark, log, str(tmp_path / "in")).withColumn("is_check", F.col("event_type") == "view").withColumn("year", year)
    got = queries.run_to_table(ledger.confirmations(stream, minutes=240), str(tmp_path / "run"))
    rows = frames[0].withColumn("year", year)
    want = batch.confirm_within(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), minutes=240)
    assert {r["event_id"]: (r["status"], r["detail"]) for r in got.collect()} == {r["event_id"]: (r["status"], r["check_id"]) for r in want.collect()}


def test_active_people(spark, log, rocks, tmp_path, days=3):
    changes = queries.run_to_table(ledger.active_changes(arriving(spark, log, str(tmp_path / "in")), days), str(tmp_path / "run"))
    got = {r["until"]: r["users"] for r in ledger.active_people(changes).collect()}
    seen = defaultdict(set)
    for _, ts, user, *_ in log:
        for n in range(1, days + 1):
            seen[ts.date() + dt.timedelta(days=n)].add(user)
    first, last = min(seen), max(seen)
    for n in range((last - first).days + 1):
        day = first + dt.timedelta(days=n)
        assert got[day] == len(seen[day])


def test_late_rows_are_counted(spark, log, rocks, tmp_path):
    late = [(5000 + i, START + dt.timedelta(hours=i), 1, "view", 0) for i in range(3)]
    stream = arriving(spark, log, str(tmp_path / "in"), extra=[*late, log[-1]])
    out, batches = queries.run_with_log(queries.daily_counts(stream.withColumn("ts", F.col("ts"))), str(tmp_path / "run"))
    by_day = defaultdict(int)
    for _, ts, *_ in log:
        by_day[ts.date()] += 1
    # a repeated event counts once, late ones don't count
    assert {r["day"].date(): r["n"] for r in out.collect()} == by_day
    total = batches.agg(F.sum("rows").alias("rows"), F.sum("late").alias("late")).first()
    assert tuple(total) == (len(log) + 5, 3)
    assert batches.where("late > 0").count() == 3 and batches.select("batch").distinct().count() == batches.count()
