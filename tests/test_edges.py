"""Cases at the edges of limits: nothing is cut, capped or dropped there."""

import datetime as dt
import json

from pyspark.sql import functions as F

from curatorium.operators import facts, kpi, ledger, matching, ordered, resolve, social
from curatorium.sources import payload, sinks

DAY = dt.datetime(2024, 1, 5, 10)


def log(spark, n, user=1):
    rows = [(user, i, i, DAY + dt.timedelta(seconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, item_id long, event_id long, ts timestamp_ntz")


def test_limits_above_five_hundred(spark):
    limits = spark.createDataFrame([(1, 600)], "user_id long, daily_limit int")
    for statuses, accepted in ((ledger.daily_quota(log(spark, 602), limits), "ok"), (ledger.admission(log(spark, 602), limits), "new")):
        assert {r["status"]: r["count"] for r in statuses.groupBy("status").count().collect()} == {accepted: 600, "limit": 2}


def test_first_k_takes_any_order_at_any_k(spark):
    rows = spark.createDataFrame([(k, i % 700, i) for k in range(2) for i in range(3000)], "k long, v long, i long")
    for k in (5, 1001, 2500):
        got = ordered.first_k(rows, ["k"], [F.col("v").desc(), "i"], k).orderBy("k", "position").collect()
        for key in range(2):
            want = sorted(((-(i % 700), i) for i in range(3000)))[:k]
            assert [(-r["v"], r["i"], r["position"]) for r in got if r["k"] == key] == [(*w, n + 1) for n, w in enumerate(want)]


def test_many_rules_are_the_same_as_few(spark):
    items = spark.createDataFrame(
        [(i, f"maker {i % 5}", f"name {i}", ["x", "y", None][i % 3]) for i in range(60)], "item_id long, maker string, name string, country string")
    rules = [{"priority": p, "country": "xy"[p % 2], "pattern": f"NAME {p % 80}$", "legend": p % 7 == 0} for p in range(501)]
    few = matching.classify(items, rules[:300]).collect()
    table = spark.createDataFrame([(r["priority"], r["country"], r["pattern"], r["legend"]) for r in rules[:300]],
                                  "priority long, country string, pattern string, legend boolean")
    assert sorted(map(str, few)) == sorted(map(str, matching.classify_table(items, table).collect()))
    assert matching.classify(items, rules).where("rule is not null").count() >= sum(r["rule"] is not None for r in few)
    assert matching.classify(items, []).where("rule is not null").isEmpty()


def test_every_day_is_counted(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 5)), (1, dt.datetime(2024, 1, 10))], "user_id long, ts timestamp_ntz")
    got = {r["day"].day: r["n"] for r in kpi.rolling_active(events, 7, "n").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 1, 9: 1, 10: 2}
    assert kpi.rolling_active(events.where("false"), 7, "n").isEmpty()


def test_fact_columns_survive_a_merge(spark):
    rows = [(1, 10, 100, 2, "rare", False, None, DAY, 1999, 3), (1, 11, 101, 1, "ultra", True, "m", DAY, 2001, 4), (2, 11, 102, None, "rare", False, None, DAY, 2002, 5),
            (2, 12, 103, None, "rare", False, None, DAY, 2003, None)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, fact_id long, bottles int, tier string, full_art boolean, memo string, created_at timestamp, "
                                     "year int, fav_rank int")
    got = {r["fact_id"]: r for r in resolve.merge_facts(df, spark.createDataFrame([(10, 11)], "keep_id long, drop_id long")).collect()}
    assert {k: (r["item_id"], r["bottles"], r["year"], r["fav_rank"]) for k, r in got.items()} == {
        100: (10, 3, 1999, 3), 102: (10, 1, 2002, 5), 103: (12, 1, 2003, None)}


def test_payload_keeps_all_signals(spark):
    signals = {"price_eur_low": 5, "price_eur_high": 0, "classification": "top", "producer_fame": "merk", "production": "klein", "rarity_nl": "gewoon",
               "vintage_quality": "goed", "large_format": True, "iconic": True}
    docs = spark.createDataFrame([(json.dumps({"naam": "x", "signals": signals}),), (json.dumps({"naam": "y", "style": "zoet"}),)], "doc string")
    a, b = payload.ingest(docs, "doc").orderBy("name").collect()
    assert [a[c] for c in ("classification", "producer_fame", "production", "rarity_nl", "vintage_quality", "large_format", "iconic", "style")] == [
        "top", "merk", "klein", "gewoon", "goed", True, True, "stil"]
    assert (a["price_eur_low"], a["price_eur_high"], b["style"], b["classification"]) == (5.0, None, "zoet", None)


def test_items_without_a_name_are_shared_by_id(spark):
    edges = spark.createDataFrame([(1, 2)], "a long, b long")
    owned = spark.createDataFrame([(1, 7), (2, 7), (1, 8), (2, 9)], "user_id long, item_id long")
    items = spark.createDataFrame([(7, None, "m"), (8, None, "m"), (9, None, "m")], "item_id long, name string, maker string")
    assert social.shared_items(edges, owned, items).first()["shared"] == 1


def test_upsert_groups_only_the_keys_of_the_delta(spark):
    base = spark.createDataFrame([(i, "old", 1) for i in range(50)], "k long, v string, t int")
    delta = spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (7, "late", 0), (99, "fresh", 1)], "k long, v string, t int")
    got = {r["k"]: r["v"] for r in facts.upsert_latest(base, delta, ["k"], ["t"]).collect()}
    assert got == {i: "old" for i in range(50)} | {3: "newer", 99: "fresh"}


def test_upsert_batches_are_compacted_bucket_by_bucket_and_may_be_replayed(spark, tmp_path):
    import random

    schema = spark.createDataFrame([], "k long, v long, t long").schema
    table = sinks.Upserts(spark, str(tmp_path / "table"), schema, ["k"], ["t"], buckets=8)
    assert table.read().collect() == [] and table.compact() is None
    rnd, want, batches = random.Random(2), {}, []
    for n in range(20):
        rows = [(rnd.randrange(60), 100 * n + i, rnd.randrange(40)) for i in range(12)]
        rows = list({r[0]: r for r in rows}.values())
        batches.append(spark.createDataFrame(rows, schema))
        table.write(batches[n], n)
        for k, v, t in rows:
            if k not in want or t >= want[k][1]:
                want[k] = (v, t)
        if n in (4, 19):
            table.compact()

    def rows_now():
        return {r["k"]: (r["v"], r["t"]) for r in table.read().collect()}

    assert rows_now() == want and table.manifest()["upto"] == 19
    # a batch that is compacted already changes nothing, not even files
    table.write(batches[3], 3)
    assert rows_now() == want and table._young(19)[0] == []
    one = spark.createDataFrame([(7, -1, 1000)], schema)
    for _ in range(2):
        table.write(one, 20)
    want[7] = (-1, 1000)
    young, touched = table._young(19)
    assert rows_now() == want and len(young) == len(touched) == 1
    plan = table.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    before = table.manifest()
    table.compact()
    after = table.manifest()
    moved = {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)}
    assert moved == {str(b) for b in touched} and rows_now() == want


def test_listing_reads_no_contents(spark, tmp_path):
    import datetime as dt
    import os

    from curatorium.sources import objects

    root, when = tmp_path / "store", dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc).timestamp()
    for i, name in enumerate(["7/a.jpg", "7/a.label.jpg", "8/a.label.jpg", "8/b.jpg", "9/b.jpg", "9/notes.txt"]):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (i + 1))
        os.utime(path, (when + i, when + i))
    files = objects.listing(spark, str(root))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert {r["path"]: r["size"] for r in files.collect()}["8/b.jpg"] == 4
    assert {r["item"]: r["path"] for r in objects.newest_object(files).collect()} == {"a": "8/a.label.jpg", "b": "9/b.jpg"}
    merges = spark.createDataFrame([("z", "a", False), ("b", "a", True)], "kept_id string, dropped_id string, moved boolean")
    facts = spark.createDataFrame([(7, "z"), (8, "z")], "user_id long, item_id string")
    (root / "8/z.label.jpg").write_bytes(b"x")
    got = [tuple(r) for r in objects.move_plan(merges, facts, objects.listing(spark, str(root))).select("source", "target").collect()]
    assert got == [("7/a.label.jpg", "7/z.label.jpg")]


def test_unknown_signal_fields_are_merged(spark):
    from curatorium.functions import signals

    rows = [(1, '{"a": 1, "b": {"c": 2}, "n": null}', '{"b": 5, "new": [1, 2], "a": null}'), (2, None, '{"x": "y"}'), (3, '{"x": 1}', None),
            (4, None, None), (5, "[1]", '{"x": 2}'), (6, "{}", "{}")]
    df = spark.createDataFrame(rows, "i int, e string, v string")
    got = {r["i"]: r["m"] for r in df.select("i", F.to_json(signals.merge_open(F.parse_json("e"), F.parse_json("v"))).alias("m")).collect()}
    assert {i: None if m is None else json.loads(m) for i, m in got.items()} == {
        1: {"a": 1, "b": 5, "new": [1, 2]}, 2: {"x": "y"}, 3: {"x": 1}, 4: None, 5: {"x": 2}, 6: {}}

def test_override_by_maker_and_name(spark):
    items = spark.createDataFrame([(1, "Great Rod", "Brand#1"), (2, "Great Rod", "Other"), (3, "Hot rod", "brand#12"), (4, None, None)], "item_id long, name string, maker string")
    got = matching.override(items.withColumn("t", F.lit("x")), "rod", "hot", "t", "y", maker="BRAND#1").orderBy("item_id").collect()
    assert [(r["t"], r["hit"]) for r in got] == [("y", True), ("x", False), ("x", False), ("x", False)]
