import random
import re

import xxhash
from pyspark.sql import functions as F

from curatorium.llm import simhash


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def components(prints, most=4):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprint_is_the_definition():
    random.seed(1)
    texts = ["", "a", "A b", "x y z é", " \x1c ü q ", "Ab cd\tef\ngh ij", None]
    texts += [" ".join(random.choice(["ä", "B", "cc", "d!"]) for _ in range(n)) for n in (3, 4, 5, 100, 700)]
    for t in texts:
        assert simhash.simhash((t or "").encode()) == brute(t)


def test_long_text_is_hashed_whole():
    text = "w " * 70_000 + "end of it"
    assert simhash.simhash(text.encode()) == brute(text)


def test_against_brute_force(spark):
    random.seed(2)
    base = [" ".join(random.choice("abcdefghij") * random.randint(1, 3) for _ in range(60)) for _ in range(30)]
    texts = [None, "", "one", "one", "two words"] + base
    for t in base[:12]:
        words = t.split()
        for _ in range(4):
            changed = list(words)
            changed[random.randrange(60)] = "zz"
            texts.append(" ".join(changed))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base[0]), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component": F.lit("x")})
    got = simhash.near_duplicates(docs).collect()
    prints = [brute(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((-1 if i is None else i, p, least[root[p]]) for (i, _), p in zip(rows, prints))
    assert sorted((-1 if r[0] is None else r[0], r[1] % 2**64, r[2]) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted(set(least.values()))


def test_crowded_blocks_lose_no_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    monkeypatch.setattr(simhash, "CELL", 16)
    random.seed(3)
    centres = [random.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << b for b in random.sample(range(12), random.randint(0, 5))) for c in centres for _ in range(120)}
    values |= {random.getrandbits(64) for _ in range(100)}
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    from curatorium.llm.components import components as connected

    got = {}
    for node, component in connected(edges).collect():
        got.setdefault(component, set()).add(node % 2**64)
    want = {}
    for v, r in components(values).items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
    assert edges.count() < len(values) * 35 * 6


def test_masks_cover_every_close_pair():
    for blocks in (6, 7, 8):
        masks = [m % 2**64 for m in simhash.block_masks(blocks, 4)]
        random.seed(blocks)
        for _ in range(200):
            x = sum(1 << b for b in random.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.one_of_each(docs).collect() == []
