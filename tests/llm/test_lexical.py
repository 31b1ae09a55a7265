"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curatorium.llm import lexical
from curatorium.llm.store import keep

DOCS, ITEMS = "doc_id long, text string, item_id int, term string", "item_id string, text string, n int"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    held = [(d[0], Counter(terms(d[1]))) for d in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    asked, out = {}, []
    for item, text, *_ in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, own in asked.items():
        rows = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in own if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, i, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def prose(draw, n):
    words = [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(n)]
    return "".join(w.upper() + draw.choice(".,-\n") if draw.random() < 0.2 else w + " " for w in words)


def corpus():
    draw = random.Random(7)
    docs = [(i, prose(draw, draw.randrange(1, 60)), i, "t") for i in range(600)]
    docs += [(1000 + i, docs[5][1], 0, None) for i in range(40)]  # copies: equal scores
    docs += [docs[9]] * 3 + [(None, docs[5][1], 1, "x"), (2, None, 1, "x"), (3, "", 1, None), (4, " .,;", 1, None)]
    docs.append((5000, prose(draw, 40_000), 1, None))
    items = [(f"q{i}", prose(draw, 1 + i), 1) for i in range(14)]
    items += [("q3", "w1 w2 été été", 1), (None, "w5 w7 w5", 2), ("none", "", 3), ("null", None, 3), ("absent", "zzz", 3)]
    return docs, items


def test_like_a_plain_search(spark):
    docs, items = corpus()
    frame, asked = spark.createDataFrame(docs, DOCS).repartition(3, "text"), spark.createDataFrame(items, ITEMS)
    for options in ({"block": 8}, {"block": 64, "query_terms": 20}):
        got = lexical.ranked(frame, asked, 10, **options)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 10)
    assert sorted(map(tuple, lexical.ranked(frame, asked, 5000).collect()), key=repr) == plain(docs, items, 5000)


def test_empty_tables(spark):
    docs, items = corpus()
    assert lexical.ranked(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
    assert lexical.ranked(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.ranked(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([("a", None, 1)], ITEMS)).collect() == []


def test_pair_bounds_hold_and_are_tighter_than_term_maxima(spark):
    docs, items = corpus()
    names = sorted({t for i in items for t in terms(i[1])})
    posted = keep(lexical.postings(spark.createDataFrame(docs, DOCS), lexical.Vocabulary(names), block=8), "postings-test")
    n, total = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = lexical._frequencies(posted, len(names))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df])
    own = [np.array(sorted({names.index(t) for t in terms(i[1])})) for i in items if terms(i[1])]
    search = lexical.Search(own, weights, n, total)
    rows = lexical._bounded(lexical.pair_index(posted, search)).collect()
    tables = {b: pa.Table.from_pandas(g) for b, g in posted.toPandas().groupby("block")}
    looser = 0
    for r in rows:
        table = tables[r["block"]]
        table = table.set_column(table.column_names.index("terms"), "terms", table.column("terms").cast(pa.list_(pa.int32())))
        at, scores = search.best(search.items[r["item"]], np.array(r["bounds"]), search.lists(table), table.num_rows, 1)
        assert r["bound"] >= scores.max()
        looser += sum(r["one"]) + sum(r["two"]) > r["bound"]
        cut = int(np.median(scores)) + 1
        again = search.best(search.items[r["item"]], np.array(r["bounds"]), search.lists(table), table.num_rows, cut)
        assert sorted(zip(*again)) == sorted((a, s) for a, s in zip(at, scores) if s >= cut)
    assert looser > len(rows) / 4
