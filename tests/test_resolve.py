"""Closed-form resolution against the sequential merge it stands for."""

import datetime as dt
import random

from curatorium.operators import resolve

SCHEMA = "item_id long, name string, maker string, color string, created_at timestamp_ntz"


def sequential(rows):
    """Pairs oldest first; a row already merged away is skipped."""
    rows = sorted(rows, key=lambda r: (r[4], r[0]))
    gone, leader = set(), {}
    for b in rows:
        for a in rows:
            if (a[4], a[0]) >= (b[4], b[0]) or a[0] in gone or b[0] in gone:
                continue
            if a[3] and b[3] and a[3].lower() != b[3].lower():
                continue
            leader[b[0]] = a[0]
            gone.add(b[0])
    return {r[0]: leader.get(r[0], r[0]) for r in rows}


def test_leaders_equal_the_loop(spark):
    rnd = random.Random(1)
    rows, blocks, n = [], [], 0
    for block in range(60):
        group = []
        for _ in range(rnd.randrange(1, 9)):
            when = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(4))
            group.append((n, f"Naam{block}", "Maker", rnd.choice(["", "rood", "wit", "Rood", None]), when))
            n += 1
        blocks.append(group)
        rows += group
    want = {}
    for group in blocks:
        want |= sequential([(i, a, b, c or "", t) for i, a, b, c, t in group])
    got = {r.item_id: r.leader_id for r in resolve.leaders(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_resolution_is_idempotent(spark):
    rows = [(i, "Château Rozier" if i % 2 else "Rozier 1998", "Dom. X", ["", "rood", "wit"][i % 3], dt.datetime(2024, 1, 1 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [r.leader_id for r in resolve.leaders(df).select("leader_id").distinct().collect()]
    again = resolve.duplicate_pairs(df.where(df.item_id.isin(kept)))
    assert again.count() == 0


def test_unknown_makers_and_short_names_stay_apart(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "Reserva", "", "rood", t), (2, "Reserva", "", "rood", t), (3, "La Y", "M", "", t), (4, "Y", "M", "", t), (5, "Reserva", "The", "", t)]
    assert resolve.leaders(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_hot_block_is_not_paired(spark):
    """A block holding almost everything costs one grouped pass: no join of rows with rows."""
    df = spark.range(20000).selectExpr("id as item_id", "'Grote Naam' as name", "'Maker' as maker", "'rood' as color",
                                       "timestamp_ntz'2024-01-01 00:00:00' as created_at")
    assert resolve.duplicate_pairs(df).count() == 19999
    stats = resolve.block_statistics(df).first()
    assert (stats["items"], stats["pairs"]) == (20000, 20000 * 19999 // 2)


def test_merge_in_one_step(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = SCHEMA + ", is_icon boolean, tier string, tier_reason string, first_user long, year int, label_style string, label_version int, label_locked boolean"
    rows = [
        (1, "Rozier", "X", "rood", t[0], False, None, None, None, None, "old", 1, False),
        (2, "Château Rozier", "X", "", t[1], False, "rare", "why", 7, 2001, "drawn", 2, False),
        (3, "Rozier 1999", "X", "rood", t[2], False, "ultra", "no", 8, 1999, None, 1, False),
    ]
    got = resolve.merge_survivors(spark.createDataFrame(rows, schema)).first()
    assert (got["item_id"], got["name"], got["tier"], got["first_user"], got["year"], got["label_style"], got["absorbed"]) == (
        1, "Château Rozier", "rare", 7, 2001, "drawn", 2)


def one_by_one(items, leader_of):
    """Merges in the order of the age of what goes, each against the keys of that moment."""
    def key(maker, name):
        return f"{(maker or '').strip().lower()}|{name.strip().lower()}"

    state = {r["item_id"]: dict(r, key=key(r["maker"], r["name"]), refused=False, absorbed=0) for r in items}
    order = sorted((r["created_at"], r["item_id"]) for r in items if leader_of.get(r["item_id"], r["item_id"]) != r["item_id"])
    for _, gone in order:
        d, k = state.pop(gone), state[leader_of[gone]]
        k["absorbed"] += 1
        if not k["label_locked"] and d["label_style"] is not None and (d["label_version"] == 2 or k["label_style"] is None or d["label_locked"]):
            k.update({c: d[c] for c in ("label_style", "label_version", "label_locked")})
        name = k["name"] if k["is_icon"] else d["name"] if d["is_icon"] or len(d["name"]) > len(k["name"]) else k["name"]
        wanted = key(k["maker"], name)
        if any(x is not k and x["key"] == wanted for x in state.values()):
            k["refused"] = True
            continue
        k.update(name=name, key=wanted, is_icon=k["is_icon"] or d["is_icon"])
        k.update({c: d[c] for c in ("tier", "tier_reason", "first_user", "year", "signals") if k[c] is None})
    return sorted((k["item_id"], k["name"], k["tier"], k["tier_reason"], k["first_user"], k["year"], k["signals"], k["is_icon"],
                   k["label_style"], k["refused"], k["absorbed"]) for k in state.values() if k["absorbed"])


def test_merges_with_contested_keys_go_one_by_one(spark):
    import datetime as dt
    import random

    rnd, items = random.Random(12), []
    names = ["Rozier", "Château Rozier", "Chateau Rozier 1998", "Domaine Rozier", "Rozier 1999", "Rozier  ", "Picard", "Domaine Picard", "picard 2001"]
    for i in range(260):
        items.append({
            "item_id": i, "name": rnd.choice(names), "maker": rnd.choice(["Dupont", "Domaine Dupont", "dupont ", "Maison Dupont", f"solo{i % 40}", f"Château solo{i % 40}", ""]),
            "color": rnd.choice(["", "rood", "wit", "Rood"]), "created_at": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(200)),
            "year": rnd.choice([None, 1990, 1991]), "is_icon": rnd.random() < 0.1, "tier": rnd.choice([None, "rare", "ultra"]),
            "tier_reason": rnd.choice([None, f"r{i}"]), "first_user": rnd.choice([None, i]), "label_style": rnd.choice([None, f"l{i}"]),
            "label_version": rnd.choice([1, 2]), "label_locked": rnd.random() < 0.1, "signals": rnd.choice([None, f"s{i}"])})
    schema = ("item_id long, name string, maker string, color string, created_at timestamp_ntz, year int, is_icon boolean, tier string, tier_reason string, "
              "first_user long, label_style string, label_version int, label_locked boolean, signals string")
    df = spark.createDataFrame([tuple(i.values()) for i in items], schema)
    leader_of = {r["item_id"]: r["leader_id"] for r in resolve.leaders(df).collect()}
    columns = ["item_id", "name", "tier", "tier_reason", "first_user", "year", "signals", "is_icon", "label_style", "key_taken", "absorbed"]
    got = sorted(tuple(r[c] for c in columns) for r in resolve.merge_survivors(df).collect())
    want = one_by_one(items, leader_of)
    assert got == want and 5 < sum(w[9] for w in want) < len(want)
