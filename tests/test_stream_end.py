"""Streamed ledgers over a log that has ended: the rows that the watermark alone would keep waiting get their status too."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from curatorium.plans.registry import CHECKS, QUERIES
from curatorium.streaming import ledger, queries
from curatorium.streaming.replay import packed, unpacked
from test_streams import arriving, rocks, statuses  # noqa: F401

START = dt.datetime(2024, 1, 5, 10)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, sf = random.Random(5), str(tmp_path_factory.mktemp("ended"))
    moments = sorted(rnd.sample(range(2 * 24 * 3600), 300))
    rows = [(i, START + dt.timedelta(seconds=s), rnd.randrange(1, 6), rnd.choice(["view", "click", "purchase"]), 0.0, f'{{"k": {rnd.randrange(60)}}}')
            for i, s in enumerate(moments)]
    names = [c.split()[0] for c in queries.EVENT_SCHEMA.split(", ")]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*rows))))), f"{sf}/events.parquet")
    spark.createDataFrame([(u, f"c{u}", u, 1.0, "AUTO") for u in range(4)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(f"{sf}/customer.parquet")
    return sf


@pytest.mark.parametrize("name, batch", [("stream_admission", "admission_ledger"), ("stream_confirm", "confirm_within")])
def test_every_event_has_a_status(spark, rocks, folder, name, batch):  # noqa: F811
    got, want = QUERIES[name](spark, folder), QUERIES[batch](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert CHECKS[name] == CHECKS[batch]


def test_the_end_comes_after_all_micro_batches(spark, rocks, tmp_path):  # noqa: F811
    log = [(i, START + dt.timedelta(minutes=10 * i), i % 3, "view", i % 7) for i in range(120)]
    limits = spark.createDataFrame([(0, 2), (1, 1)], "user_id long, daily_limit int")
    stream = arriving(spark, log, str(tmp_path / "in")).where("event_id >= 0")
    out, batches = queries.run_to_end(
        ledger.admission(stream, limits, closing=queries.closings(spark, str(tmp_path / "run"))), str(tmp_path / "run"), ledger.DELAY)
    assert len(statuses(out)) == out.count() == 120 and batches.where("late > 0").isEmpty() and batches.count() > 4


def test_packed_rows_keep_missing_and_wide_values():
    columns = [[1, None, -(1 << 63)], [None, 5, (1 << 63) - 1]]
    data = packed([np.array([v or 0 for v in c], np.int64) for c in columns], [np.array([v is None for v in c]) for c in columns])
    assert unpacked(data, 2) == list(zip(*columns)) and unpacked(b"", 2) == []
