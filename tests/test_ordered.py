"""Order-dependent helpers against plain loops, with one key owning most of the rows."""

import random

from pyspark.sql import functions as F

from curatorium.operators import geo, ordered


def skewed(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = [(7 if rnd.random() < 0.6 else rnd.randrange(40), i, rnd.randrange(100)) for i in range(n)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, t long, v long").repartition(5)


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((t, v))
    return out


def test_running_crosses_segments(spark):
    rows, df = skewed(spark)
    got = {(r.k, r.t): (r.n, r.s, r.m) for r in ordered.running(
        df, ["k"], ["t"], {"n": ("count", None), "s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") % 2 == 0, F.col("v")))}, parts=9
    ).collect()}
    for k, series in by_key(rows).items():
        total, top = 0, None
        for i, (t, v) in enumerate(series, 1):
            total += v
            top = max(x for x in (top, v if v % 2 == 0 else None) if x is not None) if (top is not None or v % 2 == 0) else None
            assert got[k, t] == (i, total, top)
    assert len(got) == len(rows)


def test_position_without_key(spark):
    rows, df = skewed(spark)
    got = [r.position for r in ordered.position(df, [], ["t"], parts=6).orderBy("t").collect()]
    assert got == list(range(1, len(rows) + 1))


def test_missing_keys_form_a_group(spark):
    df = spark.range(300).selectExpr("if(id % 3 = 0, null, 5) as k", "id as t", "if(id < 250, null, 1) as v")
    got = {r.t: (r.k, r.n, r.s) for r in ordered.running(
        df, ["k"], ["t"], {"n": ("count", None), "s": ("sum", F.col("v"))}, parts=8).collect()}
    count, total = {None: 0, 5: 0}, {None: None, 5: None}
    for t in range(300):
        k = None if t % 3 == 0 else 5
        count[k] += 1
        if t >= 250:
            total[k] = (total[k] or 0) + 1
        assert got[t] == (k, count[k], total[k])


def test_first_k_above_the_group_limit(spark):
    df = spark.range(3000).select((F.col("id") * 0).alias("k"), F.col("id").alias("t"))
    assert ordered.first_k(df, ["k"], ["t"], 1500).count() == 1500


def test_fold_equals_a_loop(spark):
    def step(state, values):
        # every fiftieth value resets; otherwise the state depends on all rows since
        (v,) = values
        acc = state[0] if state else 0
        acc = 0 if v % 50 == 0 else (acc * 31 + v) % 1_000_003
        return (acc,), (acc,)

    rows, df = skewed(spark, 900)
    for parts in (1, 4, 13):
        got = {(r.k, r.t): r.acc for r in ordered.fold(df, ["k"], ["t"], {"v": F.col("v")}, (), step, "acc long", parts).collect()}
        for k, series in by_key(rows).items():
            state = ()
            for t, v in series:
                state, (acc,) = step(state, (v,))
                assert got[k, t] == acc
        assert len(got) == len(rows)


def test_thin_rings_closes_and_drops(spark):
    square = [("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.02, 0.01), (1.0, 0.0), (1.0, 1.0), (1.1, 1.0), (0.0, 1.0)])]
    tiny = [("b", i, 0.01 * i, 0.0) for i in range(9)]
    df = spark.createDataFrame(square + tiny, "ring string, step long, lon double, lat double")
    got = [(r.ring, r.lon, r.lat) for r in geo.thin_rings(df, "ring", "step", parts=3).orderBy("ring", "step").collect()]
    assert got == [("a", 0.0, 0.0), ("a", 1.0, 0.0), ("a", 1.0, 1.0), ("a", 0.0, 1.0), ("a", 0.0, 0.0)]


def passes(monkeypatch, df):
    """Counts the passes over a frame in Python."""
    seen, kind = [], type(df)
    real = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, *a, **b: (seen.append(1), real(self, *a, **b))[1])
    return seen


def test_guarantees_over_many_segments_take_two_passes(spark, monkeypatch):
    import datetime as dt

    from curatorium.functions import chance
    from curatorium.operators import ledger

    rnd, key = random.Random(8), F.concat(F.lit("y"), F.col("event_id").cast("string"))
    rows = [(1 if i % 40 else 2, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, rnd.random() < (1.0 if 500 < i < 900 else 0.02)) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, is_icon boolean")
    drawn = {r.event_id: r.d for r in df.select("event_id", chance.draw_tier(key).alias("d")).collect()}
    want = {}
    for user in (1, 2):
        su = ss = 0
        for u, _, e, icon in rows:
            if u == user:
                tier = "icon" if icon else "ultra" if su >= 99 else "superrare" if ss >= 24 else drawn[e]
                su, ss = 0 if tier == "ultra" else su + 1, 0 if tier in ("ultra", "superrare") else ss + 1
                want[e] = (tier, su, ss)
    assert max(w[1] for w in want.values()) > 150  # icons carry the counters past the guarantee
    for parts in (1, 7, 55, 300):
        seen = passes(monkeypatch, df)
        got = {r.event_id: (r.tier, r.since_ultra, r.since_superrare) for r in ledger.guarantee(df, key, parts=parts).collect()}
        assert got == want and len(seen) == 2
        monkeypatch.undo()


def test_one_ring_over_many_segments(spark, monkeypatch):
    import math

    rnd = random.Random(9)
    rows = []
    for ring in range(3):
        x = y = 0.0
        for i in range(1500 if ring == 0 else 40):
            x, y = x + rnd.uniform(-0.2, 0.2), y + rnd.uniform(-0.2, 0.2)
            if rnd.random() < 0.1 and ring == 0:
                y = x = rnd.choice([0.0, -0.1, 3.0])  # stays close to one place for long stretches
            rows.append((ring, i, x, y))
    df = spark.createDataFrame(rows, "ring long, step long, lon double, lat double")
    snapped = {(r.ring, r.step): (r.x, r.y) for r in df.select("ring", "step", geo.snap(F.col("lon")).alias("x"), geo.snap(F.col("lat")).alias("y")).collect()}
    want = set()
    for ring in range(3):
        last, kept = None, []
        for (_, i), p in sorted((k, v) for k, v in snapped.items() if k[0] == ring):
            if last is None or math.hypot(p[0] - last[0], p[1] - last[1]) >= geo.MIN_DISTANCE:
                last = p
                kept.append((ring, i, *p))
        if len(kept) >= 4:
            want |= set(kept) | ({(ring, kept[-1][1] + 1, *kept[0][2:])} if kept[0][2:] != kept[-1][2:] else set())
    for parts in (1, 40, 400):
        seen = passes(monkeypatch, df)
        got = {(r.ring, r.step, r.lon, r.lat) for r in geo.thin_rings(df, "ring", "step", parts=parts).collect()}
        assert got == want and len(seen) == 2
        monkeypatch.undo()
