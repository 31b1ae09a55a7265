import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from curatorium.llm import minhash, sigtree, words


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(n, seed):
    random.seed(seed)
    return " ".join(random.choice(["ä", "lorem", "x1", "Y,"]) + str(random.randrange(50)) for _ in range(n))


def test_words_of_a_column():
    texts = ["a b", "", None, "a\tb\x0bc\r", "  lead", "b", "é x y", "a" * 700_000 + " b", "z " * 300_000]
    data, starts = words.raw(pa.array(texts))
    hashed, first = words.word_hashes(data, starts)
    want = [(t or "").encode().split() for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    known = {}
    for h, w in zip(hashed.tolist(), [w for ws in want for w in ws]):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_of_arrow_arrays_are_respected():
    whole = pa.array(["x y", "a b c", None, "d"])
    data, starts = words.raw(whole.slice(1, 3))
    assert bytes(data) == b"a b cd" and starts.tolist() == [0, 5, 5, 6]


def test_minima_are_those_of_each_text_alone():
    texts = [prose(n, n) for n in (0, 1, 4, 5, 6, 50)] + [prose(40_000, 1), None, "", prose(30, 2)]
    together = minhash.signatures(pa.array(texts))
    for t, row in zip(texts, together):
        assert (minhash.signatures(pa.array([t], pa.string()))[0] == row).all()


def test_likeness_estimates_jaccard():
    a = prose(2000, 1)
    w = a.split()
    for share in (0.0, 0.1, 0.5, 1.0):
        b = " ".join(w[: int(len(w) * (1 - share))] + prose(int(len(w) * share), 9).split())
        x, y = shingles(a), shingles(b)
        got = minhash.likeness(*(minhash.signatures(pa.array([t], pa.string())) for t in (a, b)))[0]
        assert abs(got - len(x & y) / len(x | y)) < 0.15


@pytest.mark.parametrize("parts", [1, 4])
def test_with_next_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(minhash, "parts_for", lambda *a: parts)
    texts = [None, "", "é" * 9, "one", prose(80, 1), prose(81, 2), prose(80, 1), "x" * 100_001, "ü ß", " "]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "none"), (6, "again")]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").selectExpr("*", "1 as kind", "2 as part")
    got = minhash.with_next(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (minhash.signatures(pa.array([x])) for x in (t, edited, n))
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes(), b.tobytes(),
                                       minhash.likeness(a, b)[0], minhash.likeness(a, c)[0]))
    have = {}
    for r in got:
        have.setdefault(r[0], []).append((r[1], r[2], bytes(r[3]), bytes(r[4]), r[5], r[6]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_one_row_follows_itself_and_none_gives_none(spark):
    one = minhash.with_next(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert minhash.with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def classes(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (not x and not y) or (x | y and len(x & y) / len(x | y) >= least):
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted(((d is None, d or 0), smallest.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("crowd", [64, 2])
def test_groups_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(sigtree, "CELL", 4)
    rows = [(i, prose(150, i)) for i in range(12)]
    for i in range(6):
        w = rows[i][1].split()
        for k in range(1, 8):  # ever further from the first, so chains matter
            w = [*w[: k * 3], f"new{i}.{k}", *w[k * 3 + 1 :]]
            rows.append((100 + i * 10 + k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "  "), (203, "a b"), (204, "a b"), (None, rows[0][1]), (205, rows[0][1].replace(" ", "  ")), (206, "only"), (5, rows[3][1])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as content", "2 as band"))
    assert sorted(((r[0] is None, r[0] or 0), r[1]) for r in got.collect()) == classes(rows)


def test_groups_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
