"""The time-based reports as Structured Streaming.

Event time is `ts`; rows later than the watermark are dropped by the engine and counted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "batch long, rows long, late long, watermark string"
CLOSING_SCHEMA = "ts timestamp"
WATERMARK = "1 hour"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumns({
        "ts": F.col("ts").cast("timestamp"), "item_id": F.get_json_object("props", "$.k").cast("long")})


def daily_counts(events: DataFrame) -> DataFrame:
    """Closed days with their number of events, each event once. Telling repeated events apart comes first, and is where
    late rows are dropped one by one, so that progress counts rows and not groups of them."""
    return (
        events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "n")
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything there is now, into files with their own checkpoint, and return the result."""
    return run_with_log(stream, folder, mode)[0]


def run_with_log(stream: DataFrame, folder: str, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """`run_to_table`, and beside it a row per micro-batch: rows read (as observed by the query), rows dropped because they were
    later than the watermark, and the watermark it ran with. The rows are added to the folder's log, so later runs continue it."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = [(p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]),
             p["eventTime"].get("watermark")) for p in map(lambda p: json.loads(p.json), query.recentProgress)]
    spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return spark.read.schema(stream.schema).parquet(f"{folder}/data"), spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log")


def closings(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of closing moments of the folder's run; `run_to_end` adds one."""
    spark.createDataFrame([], CLOSING_SCHEMA).write.mode("append").parquet(f"{folder}/closing")
    return spark.readStream.schema(CLOSING_SCHEMA).parquet(f"{folder}/closing")


def run_to_end(stream: DataFrame, folder: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """`run_with_log` for a log that has ended: once everything is read, a closing moment behind the last event moves the watermark
    past it, and the same run goes on. The stream reads `closings` of the folder; `delay` is its watermark's."""
    _, log = run_with_log(stream, folder)
    # the watermark is the last event less the delay
    ends = log.agg((F.max(F.to_timestamp("watermark")) + F.expr(f"2 * INTERVAL {delay} + INTERVAL 1 SECOND")).alias("ts"))
    ends.where("ts is not null").coalesce(1).write.mode("append").parquet(f"{folder}/closing")
    return run_with_log(stream, folder)


def run_counts(counts: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run a streaming count (keys and `n`) and return the latest value of every key. Each micro-batch leaves the counts it
    changed under its id, so one that runs again replaces its own."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start()
    query.awaitTermination()
    # counts only grow
    saved = counts.sparkSession.read.schema(counts.schema).parquet(f"{folder}/data")
    return saved.groupBy(*keys).agg(F.max("n").alias("n"))
