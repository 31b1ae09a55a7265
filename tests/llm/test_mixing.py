import hashlib
import re

from pyspark.sql import functions as F

from curatorium.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(sizes, most=3):
    """Water filling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= most * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= full
    return out


def brute(rows):
    total, by = sum(size(t) for _, t, _ in rows), {}
    for i, t, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"0|{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, size(t)))
    goal = goals({s: sum(x[2] for x in xs) for s, xs in by.items()})
    queue = []
    for s, xs in by.items():
        upto, whole = 0, sum(x[2] for x in xs)
        for deal, i, n in sorted(xs):
            upto += n
            if n:
                queue += [((2 * upto - n + 2 * k * whole) / (2 * goal[s]), s is None, s or "", deal, i, n) for k in range(3)]
    taken, used = {}, 0
    for x in sorted(queue):
        used += x[-1]
        if used > total:
            break
        taken[x[4], x[2]] = taken.get((x[4], x[2]), 0) + x[-1]
    return {(i, s): (size(t), goal[s], taken.get((-1 if i is None else i, s or ""), 0)) for i, t, s in rows}


def sample():
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 7}" if i % 3 else "s0") for i in range(400)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "a b", None), (None, "x y z", "s2"), (1003, " \t", "empty"), (1004, "v " * 30_000, "é"),
             (1005, "ü", "Z")]
    return rows


def test_words(spark):
    texts = [None, "", " ", "a", " a  b\t\nc ", "\x0b\x0c", "é\u00a0b", "x\x1cy"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(
        mixing.word_count(F.col("t"))).collect()]
    assert got == [size(t) for t in texts]


def test_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copies": F.lit("c"), "_id": F.lit("i"), "target": F.lit(0)})
    got = mixing.mixed(docs.repartition(5)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, goal, taken = want[r["doc_id"], r["source"]]
        assert r["size"] == n and abs(r["target"] - goal) < 1e-6 * max(1, goal) and r["taken"] == taken and taken <= 3 * n
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    assert counts == {k: t // n for k, (n, _, t) in want.items() if t}


def test_sources_come_near_their_targets(spark):
    rows = [r for r in sample() if size(r[1]) < 100]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 100


def test_repeated_rows_and_reruns(spark):
    rows = [(1, "a b c", "x")] * 5 + [(2, "d " * 40, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(mixing.mixed(docs).collect()) for _ in range(2))
    assert a == b and len(a) == 6 and len(set(a[:5])) == 1
    per_row = [r["copies"] for r in a]
    assert mixing.mix(docs).count() == sum(per_row)


def test_a_cut_among_repeated_rows(spark):
    """Whatever the cut, equal rows have equal copies, and the mix has just as many."""
    for n in range(3, 30, 4):
        rows = [(1, "a b c", "x")] * 10 + [(i, "d " * (2 + i), "xy"[i % 2]) for i in range(2, n)] + [(None, "e f", None)] * 3
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mixed(docs).collect()
        assert len(got) == len(rows) and len({r["copies"] for r in got if r["doc_id"] == 1}) == 1
        want = {}
        for r in got:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
        have = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
        assert have == {k: v for k, v in want.items() if v} and sum(r["taken"] for r in got) <= sum(size(t) for _, t, _ in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(none).collect() == [] and mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, "", "x"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mixed(blank).collect()] == [0, 0]
