"""Keyed state machines that see a stream's rows in event time order, whatever order they arrive in.

Rows wait in their key's list until the watermark has passed them. A key has one timer, just after its earliest waiting row; when it
fires, all rows before the watermark leave the list at once, sorted by (ts, event_id), and go through the machine together.
Rows are kept packed, an entry a micro-batch, so a key costs a few state calls, however many rows it has. Rows later than the watermark are dropped by the
engine and counted in its progress; `with_late` gives them a status. State of a key is what waits and what its machine
keeps; a micro-batch is bounded by the source's trigger options. A machine is sequential, so one key's rows of a micro-batch
are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

OUTPUT = "user_id long, event_id long, status string, detail long"
PACKED = StructType([StructField("rows", BinaryType())])


def packed(columns: list[np.ndarray], missing: list[np.ndarray]) -> bytes:
    """Columns of longs and of what is missing in them, in one value."""
    return b"".join(c.astype("<i8").tobytes() for c in columns) + b"".join(m.astype(np.bool_).tobytes() for m in missing)


def unpacked(data: bytes, width: int) -> list[tuple]:
    """The rows, missing values as None."""
    n = len(data) // (9 * width)
    values = np.frombuffer(data, "<i8", n * width).reshape(width, n)
    missing = np.frombuffer(data, np.bool_, n * width, 8 * n * width).reshape(width, n)
    columns = [v.tolist() if not m.any() else [None if gone else x for x, gone in zip(v.tolist(), m.tolist())] for v, m in zip(values, missing)]
    return list(zip(*columns))


class OrderedReplay(StatefulProcessor):
    """Subclasses name the columns they need (all longs), keep their state in `open`, and answer due rows in `drain`."""

    columns: tuple[str, ...] = ()
    output: tuple[str, ...] = ("user_id", "event_id", "status", "detail")

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def drain(self, key: int, rows: list[tuple]) -> list[tuple]:
        """Output rows for rows (at, event, *columns) in order; missing values are None."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))
        self.open(handle)

    def _wait(self, earliest: int) -> None:
        # a timer fires when the watermark reaches it, a row is due when the watermark has passed it; a timer set anew for the
        # moment at which it fires would be deleted with the old one
        at, before = earliest + 1, self.due.get()[0] if self.due.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "event_id", *self.columns]
        for frame in rows:
            if len(frame):
                missing = [frame[c].isna().to_numpy() for c in names]
                self.waiting.appendValue((packed([frame[c].fillna(0).to_numpy() if m.any() else frame[c].to_numpy() for c, m in zip(names, missing)], missing),))
                self._wait(int(frame["at"].min()))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        width = 2 + len(self.columns)
        rows = [r for entry in self.waiting.get() for r in unpacked(bytes(entry[0]), width)]
        ready, later = sorted(r for r in rows if r[0] < until), [r for r in rows if r[0] >= until]
        self.waiting.clear()
        self.due.clear()
        if later:
            columns = [np.array([0 if v is None else v for v in c], np.int64) for c in zip(*later)]
            self.waiting.put([(packed(columns, [np.array([v is None for v in c]) for c in zip(*later)]),)])
            self._wait(min(r[0] for r in later))
        out = self.drain(int(key[0]), ready)
        if out:
            # Python's own values, which become the output's types at once
            yield pd.DataFrame({name: pd.Series(c, dtype=object) for name, c in zip(self.output, zip(*out))})

    def close(self) -> None:
        pass


def replayed(events: DataFrame, machine: OrderedReplay, delay: str, output: str = OUTPUT, closing: DataFrame | None = None) -> DataFrame:
    """What the machine answers; rows need user_id, event_id, ts and the machine's columns. `closing` is a stream of moments (ts)
    that move the watermark on and are no events: after the last row they release what still waits."""
    rows = events.select(
        "user_id", "event_id", "ts", F.unix_millis("ts").alias("at"), *[F.col(c).cast("long").alias(c) for c in machine.columns])
    if closing is not None:
        rows = rows.withColumn("_closing", F.lit(False)).unionByName(closing.select("ts", F.lit(True).alias("_closing")), allowMissingColumns=True)
    rows = rows.withWatermark("ts", delay)
    if closing is not None:
        # names ts, or the planner would put it below the watermark
        rows = rows.where("not _closing or ts is null").drop("_closing")
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=machine, outputStructType=output, outputMode="append", timeMode="EventTime")


def with_late(log: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every row of the log with its status; rows that the stream dropped are late."""
    return log.join(statuses.select("event_id", "status"), "event_id", "left").withColumn("status", F.coalesce("status", F.lit("late")))
