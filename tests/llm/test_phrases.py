"""Collocations against a plain count over whole texts."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from curatorium.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain(rows, least, top):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals["und" if lang is None else lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    for lang, f in counts.items():
        wide = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in wide.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in wide.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def found(spark, rows, least, top):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(df, least, top).collect()))


def prose(seed, n, vocabulary):
    draw = random.Random(seed)
    ends = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "; ", "!", "\x0b"]
    return "".join(draw.choice(vocabulary) + draw.choice(ends) for _ in range(n))


def test_like_a_plain_count(spark):
    few, more = ["A", "b", "ça", "ñ", "Éa", "x-y"], [f"w{i}" for i in range(40)]
    rows = [(i, prose(i, 300, few if i % 3 else more), ["en", "fr", None, ""][i % 4], "clash", i) for i in range(24)]
    rows += [(1, "new york city hall at new york city hall", "en", None, None)] * 7  # repeated rows
    rows += [(None, None, "en", None, 1), (5, "", "de", None, 1), (6, " .,\n\t", "de", None, 1)]
    rows += [(7, "same " * 3000, "long", None, 1), (8, " ".join(f"q{i % 90}" for i in range(20_000)), "long", None, 1)]
    assert found(spark, rows, 4, 60) == plain(rows, 4, 60)


def test_ties_go_by_bytes_and_the_list_ends_at_top(spark):
    rows = [(i, "zz yy. aa bb. éé aa", "t", None, None) for i in range(5)]
    got = found(spark, rows, 5, 2)
    assert got == plain(rows, 5, 2) and [r[2] for r in got] == ["zz yy", "aa bb"]


def test_a_full_bit_table_changes_nothing(spark):
    rows = [(i, prose(i, 200, [f"w{j}" for j in range(12)]), "en", None, i) for i in range(20)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), 5, 100, log_bits=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 100)


def test_empty_table(spark):
    assert found(spark, [], 1, 10) == []


@pytest.mark.parametrize("n", [1, 4, 5, 6, 500])
def test_chunks_hold_every_phrase_once(n):
    words = [f"w{random.Random(n + i).randrange(9)}" for i in range(n)]
    _, last, found_ = phrases.chunks(pa.array([" ".join(words)]))
    parts = [c.split(" ") for c in found_.to_pylist()]
    for size in range(1, phrases.LONGEST + 1):
        got = []
        for part, end in zip(parts, last):
            begins = len(part) - size + 1 if end else len(part) - phrases.OVERLAP
            got += [tuple(part[i : i + size]) for i in range(max(begins, 0))]
        assert got == [tuple(words[i : i + size]) for i in range(n - size + 1)]
    assert last.sum() == 1 and (n < 100 or len(parts) > 1)


def test_equal_passages_share_chunks():
    passage = " ".join(f"p{i}" for i in range(400))
    _, _, found_ = phrases.chunks(pa.array([f"one two {passage} three", f"four {passage}"]))
    both = Counter(found_.to_pylist())
    assert sum(n > 1 for n in both.values()) > len(both) / 2
