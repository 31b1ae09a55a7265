"""Streams over the given events, run until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.plans.bindings import Data
from curatorium.plans import q_ledger, q_text
from curatorium.sources.sinks import Upserts, shared_folder
from curatorium.streaming import ledger, queries

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark, sf_dir):
    return queries.read_events(spark, sf_dir, "events.parquet")


def stream_daily(spark, sf_dir):
    out = queries.run_to_table(queries.daily_counts(_events(spark, sf_dir)), shared_folder(spark, "stream-daily"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def stream_late(spark, sf_dir):
    """Rows and late rows of the daily counts, from the log of their micro-batches."""
    _, log = queries.run_with_log(queries.daily_counts(_events(spark, sf_dir)), shared_folder(spark, "stream-late"))
    return log.agg(F.sum("rows").alias("rows"), F.sum("late").alias("late"))


def stream_active(spark, sf_dir):
    """People active in the seven days before each closed day, out of the stream."""
    folder = shared_folder(spark, "stream-active")
    changes, log = _with_state(spark, ledger.active_changes(_events(spark, sf_dir), delay=queries.WATERMARK), folder)
    closed = log.agg(F.max(F.to_timestamp("watermark")).alias("w")).first()["w"]
    return ledger.active_people(changes).where(F.col("until").cast("timestamp") <= F.lit(closed)).select(
        F.date_format("until", "yyyy-MM-dd").alias("until"), "users")


def _with_state(spark, stream, folder, run=queries.run_with_log):
    """Result and log, with the state store that keyed state machines need."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        return run(stream, folder)
    finally:
        spark.conf.unset(_STATE_STORE) if before is None else spark.conf.set(_STATE_STORE, before)


def _to_end(stream, folder):
    return queries.run_to_end(stream, folder, ledger.DELAY)


def stream_confirm(spark, sf_dir):
    """The statuses of confirm_within for all events; a closing moment releases the last ones."""
    folder = shared_folder(spark, "stream-confirm")
    rows = _events(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')").select(
        "user_id", "event_id", "ts", (F.col("event_type") == "view").alias("is_check"),
        F.when(F.col("item_id") % 5 != 0, 1990 + F.col("item_id") % 2).alias("year"))
    out, _ = _with_state(spark, ledger.confirmations(rows, minutes=720, closing=queries.closings(spark, folder)), folder, _to_end)
    return out.select("event_id", F.col("detail").alias("check_id"), "status")


def stream_admission(spark, sf_dir):
    """The statuses of admission_ledger for all events; a closing moment releases the last ones."""
    folder = shared_folder(spark, "stream-admission")
    limits = Data(spark, sf_dir).users.withColumn("daily_limit", F.when(F.col("daily_limit") > 2, 2).otherwise(1))
    rows = _events(spark, sf_dir).withColumn("item_id", F.col("item_id") % 25)
    out, _ = _with_state(spark, ledger.admission(rows, limits, closing=queries.closings(spark, folder)), folder, _to_end)
    return out.select("event_id", "status")


def stream_caps(spark, sf_dir):
    """The statuses of cap_ledger for all events that the watermark has passed: caps per person, whose results are a stream of
    their own into counts per month and hour."""
    folder = shared_folder(spark, "stream-caps")
    calls = _events(spark, sf_dir).withColumn("user_id", F.col("user_id") % 15)
    judged, _ = _with_state(spark, ledger.day_caps(calls, Data(spark, sf_dir).users, day_cap=10), f"{folder}/days")
    again = spark.readStream.schema(judged.schema).parquet(f"{folder}/days/data")
    hours = queries.run_counts(ledger.hourly(again), f"{folder}/hours", ["month", "hour"])
    return ledger.month_caps(judged, hours, month_cap=6000)


def stream_upsert(spark, sf_dir):
    """The last event per person and item, upserted from micro-batches whose rows overlap in time and compacted half way."""
    cols = ["user_id", "item_id", "event_type", "ts", "event_id"]
    folder, rows = shared_folder(spark, "stream-upsert"), Data(spark, sf_dir).attempt.select(*cols)
    rows.withColumn("part", F.col("event_id") % 4).write.partitionBy("part").parquet(f"{folder}/in")
    table = Upserts(spark, f"{folder}/out", rows.schema, ["user_id", "item_id"], ["ts", "event_id"])

    def save(batch, number):
        table.write(batch, number)
        if number % 3 == 2:
            table.compact()

    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("user_id", "item_id", "event_type", "event_id")


QUERIES = {f.__name__: f for f in (stream_daily, stream_late, stream_active, stream_confirm, stream_admission, stream_caps, stream_upsert)}



def _passed(name: str, delay: str) -> str:
    """The batch ledger's check, for the events before the last watermark."""
    return f"select * from ({q_ledger.CHECKS[name]}) q where event_id in (select event_id from events where ts < (select max(ts) - interval '{delay}' from events))"


CHECKS = {
    "stream_late": "select count(*) as rows, 0 as late from events",
    "stream_caps": _passed("cap_ledger", ledger.DELAY),
    "stream_daily": """select cast(ts::date as varchar) as day, count(*) as n from events
      where ts::date + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1""",
    "stream_confirm": q_ledger.CHECKS["confirm_within"],
    "stream_upsert": q_text.CHECKS["upsert_latest"],
    "stream_active": """with d as (select distinct ts::date as day from events),
      u as (select distinct day + n::int as until from d, range(1, 8) r(n))
      select cast(until::date as varchar) as until, count(distinct user_id) as users from u join events on ts::date >= until - 7 and ts::date < until
      where until <= (select max(ts) - interval 1 hour from events) group by 1""",
    "stream_admission": q_ledger.CHECKS["admission_ledger"],
}
