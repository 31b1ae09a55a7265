"""What one task or the driver holds must not grow with the number of people, items or rounds."""

import datetime as dt
import re

from pyspark.sql import functions as F

from curatorium.plans.registry import QUERIES

DAY = dt.datetime(2024, 1, 5, 10)


def test_no_sketch_for_every_person(spark, tmp_path):
    rows = [(i, DAY, u, kind, 0.0, "{}") for i, (u, kind) in enumerate([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (3, None), (None, "b")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    out = QUERIES["active_approx"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {("a", 2, True), (None, 1, True), ("b", 0, True)}
    sketched = re.findall(r"Aggregate\(keys=\[([^\]]*)\], functions=\[[^\]]*approx_count_distinct", out._jdf.queryExecution().executedPlan().toString())
    assert sketched and not any("user_id" in keys for keys in sketched)


def test_merges_send_no_table_through_the_driver(spark, tmp_path):
    from curatorium.operators import resolve

    rows = [(i, f"wine {i // 3}", "maker", ["", "red", None][i % 3], DAY, False, None, None, None, 1990, None, 1, False) for i in range(30)]
    spark.createDataFrame(
        rows, "item_id long, name string, maker string, color string, created_at timestamp_ntz, is_icon boolean, tier string, tier_reason string, "
        "first_user long, year int, label_style string, label_version int, label_locked boolean").write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    for out, want in ((resolve.leaders(items), 30), (resolve.merge_survivors(items), 10)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == want


def test_tasks_follow_the_rows_of_a_join(spark, tmp_path, monkeypatch):
    from curatorium.plans import bindings

    orders = [(o, o % 3, DAY + dt.timedelta(days=o)) for o in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(o, (7 * o + n) % 90, n, float(n)) for o in range(60) for n in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(QUERIES["milestones"](spark, str(tmp_path)).collect())
    monkeypatch.setattr(bindings, "ROWS_PER_TASK", 10)
    dealt = QUERIES["milestones"](spark, str(tmp_path))
    # 300 rows in tasks of ten: both sides of the join, and the facts
    assert dealt._jdf.queryExecution().executedPlan().toString().count(", 30), REPARTITION_BY_NUM") == 3
    assert sorted(dealt.collect()) == want and {r["n"] for r in want} == {10, 25, 50}


def test_few_links_take_few_tasks_a_round(spark, monkeypatch):
    from curatorium.operators import components

    seen, cut = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: seen.append(kept := cut(df)) or kept)
    confs = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = components.components(spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(7)]
    assert len(seen) > 1 and all(df.rdd.getNumPartitions() <= components.LEAST_TASKS for df in seen[1:])
