"""Signature trees against the Jaccard likeness of every pair."""

import random
import re

import numpy as np

from curatorium.llm import sigtree

SCHEMA = "doc_id long, text string, content string, keys int"


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def plain(rows, percent=90):
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, percent=90):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, sigtree.near_sets(df, percent).collect()), key=repr)


def changed(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"x{draw.randrange(10**6)}"
    return out


def corpus(seed):
    draw = random.Random(seed)
    rows, i = [], 0
    for size in (3, 5, 11, 12, 20, 40, 90, 200, 400):
        for _ in range(4):
            base = [f"w{draw.randrange(3000)}" for _ in range(size)]
            for n in (0, 0, 1, 1, 2, 3, 5, 8, 13):
                text = " ".join(changed(draw, base, min(n, size)))
                rows.append((i, text.upper() if n == 1 else text.replace(" ", "\n \t", 3), "c", i))
                i += 1
    return draw, rows


def test_like_every_pair(spark):
    _, rows = corpus(1)
    rows += [(9000, None, "c", 1), (9001, "", None, 1), (9002, " \n", None, None), (9003, "One", "c", 1), (9004, "one", "c", 1),
             (9005, "one two", "c", 1), (None, rows[0][1], "c", 1), (None, "alone in this world", "c", 1), rows[3], rows[3], (3, "other text of a known id", "c", 2)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert found(spark, rows, 75) == plain(rows, 75)


def test_a_large_family_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "CELL", 8)
    draw, rows = corpus(2)
    base = [f"v{draw.randrange(3000)}" for _ in range(300)]
    rows += [(10_000 + i, " ".join(changed(draw, base, draw.choice([0, 1, 3, 4, 6, 9]))), "c", i) for i in range(70)]
    rows += [(20_000 + i, " ".join(base), "c", i) for i in range(30)]
    walk = list(base)
    for i in range(25):  # a chain: neighbours link, ends don't
        walk = changed(draw, walk, 4)
        rows.append((30_000 + i, " ".join(walk), "c", i))
    assert found(spark, rows) == plain(rows)


def test_very_long_text_and_empty_table(spark):
    draw = random.Random(5)
    long = [f"u{draw.randrange(9000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long), "c", 1), (2, " ".join(changed(draw, long, 200)), "c", 1), (3, " ".join(changed(draw, long, 3000)), "c", 1)]
    assert found(spark, rows) == plain(rows) and found(spark, []) == []


def test_linked_sets_share_a_part():
    draw = np.random.default_rng(3)
    for percent in (90, 75):
        for _ in range(400):
            a = np.unique(draw.integers(0, 1 << 63, int(draw.integers(1, 120)), dtype=np.uint64))
            most = len(a) * (100 - percent) // (100 + percent) * 2 + 2
            b = np.unique(np.concatenate([np.delete(a, draw.integers(0, len(a), int(draw.integers(0, most)))),
                                          draw.integers(0, 1 << 63, int(draw.integers(0, most)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sigtree.part_keys([a, b], percent)
                assert len(np.intersect1d(x, y))


def test_trees_lose_no_link():
    draw = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = np.unique(draw.integers(0, 1 << 63, int(draw.integers(1, 300)), dtype=np.uint64))
        for _ in range(4):
            sets.append(np.unique(np.concatenate([np.delete(base, draw.integers(0, len(base), len(base) // 15)), draw.integers(0, 1 << 63, len(base) // 30, dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    want = {(i, j) for j in range(len(sets)) for i in range(j)
            if 190 * len(np.intersect1d(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))}
    for log_bits in (6, 10):
        tree = sigtree.Tree(sets, log_bits)
        i, j = sigtree.traverse(tree, tree, 90)
        assert want <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < len(sets) * (len(sets) - 1) / 8
    half = sigtree.Tree(sets[:50], 10), sigtree.Tree(sets[50:], 10)
    i, j = sigtree.traverse(*half, 90)
    assert {(a, b) for a, b in want if a < 50 <= b} <= set(zip(i.tolist(), (j + 50).tolist()))
