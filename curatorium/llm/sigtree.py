"""Jaccard join of word n-gram sets by signature trees.

Texts: ASCII letters in lower case, words are runs without ASCII white space; a set holds the distinct runs of three words, the
whole text if it has fewer. Null and wordless texts have an empty set, linked with nothing. Sets link when 100 * intersection is at
least `percent` * union. Equal sets are one node, whatever their number of documents.

Every tree is a family: sets that can reach one another at all. Linked sets differ in at most d elements, d following from their
sizes, so of d + 1 parts into which a hash deals the elements one is equal; sets with an equal part, over any chain, are a family.
Sizes fall into classes whose neighbours alone can link; a set deals itself out for its own class and the next one. A part
without elements says little, so sets with such a part are dealt out a second time by another hash instead.

A family's sets, in order of size, are the leaves of a tree whose nodes hold the OR of the token bitmaps below, the range of the
sizes, and the most elements that share a bit. Trees are traversed in pairs, a tree with itself at first: a pair of nodes is
dropped when sizes are too far apart or when the bits in common cannot reach the overlap needed (cells also when everything in
both is known to be linked). What is left at the leaves is counted exactly, unless it is linked already.

A family of more than CELL sets is cut into cells. Each cell is traversed with itself and the family's pivot (the set of most
documents). The sets outside the family's largest component so far, mostly few, then meet every cell whose node can still reach
them. So n near copies of one text need n sets moved, not n^2 / CELL; a family whose members rarely link needs more.

Repeated rows and ids are allowed; other columns are not read. An empty table gives no rows; a null id has component null only
if no document of its component has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from curatorium.llm import words
from curatorium.llm.bpe import slices
from curatorium.llm.components import components
from curatorium.llm.store import attach, keep, one_text_each
from curatorium.operators.ordered import position

SHINGLE, PERCENT = 3, 90
CELL, FANOUT = 512, 8
LONGS = 16  # of the bitmaps in which Spark compares cells
_PAIRS = 1 << 15


def size_class(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of every size, and the largest size of every class, one class more than needed."""
    tops, low, most = [], 1, int(size.max(initial=1))
    while not tops or len(tops) < 2 or tops[-2] < most:
        tops.append(max(low, -(-100 * low // percent) - 1))
        low = tops[-1] + 1
    return np.searchsorted(tops, size), np.array(tops)


def part_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Of every set the hashes of its parts; sets that link have one in common."""
    sizes = np.array([len(s) for s in sets])
    own, tops = size_class(sizes, percent)
    values = words.mix(np.concatenate(sets)) if len(sets) else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), sizes)
    found: list[list[np.ndarray]] = [[] for _ in sets]
    high, low = values >> np.uint64(32), values & np.uint64(0xFFFFFFFF)
    for step in (0, 1):
        scheme = own + step
        parts = 2 * tops[scheme] * (100 - percent) // (100 + percent) + 1
        begin = np.concatenate([[0], np.cumsum(parts)])
        blank = np.zeros(len(sets), bool)
        for level, digits in enumerate((high, low)):
            part = ((digits * parts[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            sums, filled = np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], bool)
            np.add.at(sums, begin[of] + part, values)
            filled[begin[of] + part] = True
            whose = np.repeat(np.arange(len(sets)), parts)
            number = np.arange(begin[-1]) - begin[whose]
            named = words.mix(sums + words.mix(((scheme[whose].astype(np.uint64) * np.uint64(2) + np.uint64(level)) << np.uint64(32)) + number.astype(np.uint64)))
            for i in range(len(sets)):
                mine = slice(begin[i], begin[i + 1])
                if level == 0:
                    blank[i] = not filled[mine].all()
                    found[i].append(named[mine][filled[mine]])
                elif blank[i]:
                    found[i].append(named[mine])
    return [np.unique(np.concatenate(f)) for f in found]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of every text its different shingle hashes, sorted."""
    data, starts = words.raw(pc.ascii_lower(texts))
    for a, b in words.blocks(starts):
        hashed, first = words.word_hashes(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        values, begins = words.shingle_hashes(hashed, first, SHINGLE)
        for i in range(b - a):
            yield np.unique(values[begins[i] : begins[i + 1]])


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())


def _keyed(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row_hash, content, n_shingles, keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                sets = list(shingle_sets(part.column("text")))
                keys = part_keys(sets, percent)
                sizes = np.array([len(s) for s in sets])
                keys = [k if n else k[:0] for k, n in zip(keys, sizes)]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_hash"), _digests(sets), pa.array(sizes.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "row_hash", "content", "n_shingles", "keys"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    return rows.mapInArrow(run, "doc_id long, row_hash long, content binary, n_shingles long, keys array<long>")


def _families(nodes: DataFrame) -> DataFrame:
    """(node, family) of the sets that have a part in common with another one. Nodes go by a 64-bit name of their content; two
    under one name would only be in one family."""
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    edges = dealt.join(shared.drop("_n"), "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(keep(edges.distinct(), "part-edges")).select("node", F.col("component").alias("family"))


class Tree:
    """Nodes of a family's or a cell's sets; level 0 has one node a set, the last one node in all."""

    def __init__(self, sets: list[np.ndarray], log_bits: int):
        n, size = len(sets), 1 << log_bits
        bits = np.zeros((n, size), bool)
        for row, s in enumerate(sets):
            bits[row, (s & np.uint64(size - 1)).astype(np.int64)] = True
        length = np.array([len(s) for s in sets])
        self.levels = [(np.packbits(bits, axis=1).view(np.uint64), length, length, length - bits.sum(1))]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare = self.levels[-1]
            heads = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, heads), np.minimum.reduceat(low, heads),
                                np.maximum.reduceat(high, heads), np.maximum.reduceat(spare, heads)))


def _reach(one: tuple, two: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below nodes i and j can have the overlap that the smallest of them need."""
    (bits, low, high, spare), (bits2, low2, high2, spare2) = one, two
    fits = (100 * high[i] >= percent * low2[j]) & (100 * high2[j] >= percent * low[i])
    out = np.flatnonzero(fits)
    for at in range(0, len(out), _PAIRS):
        part = out[at : at + _PAIRS]
        a, b = i[part], j[part]
        common = np.bitwise_count(bits[a] & bits2[b]).sum(1, dtype=np.int64) + np.minimum(spare[a], spare2[b])
        # intersection >= percent / (100 + percent) of both sizes, and at least `percent` of the larger set
        enough = ((100 + percent) * common >= percent * (low[a] + low2[b])) & (100 * common >= percent * np.maximum(low[a], low2[b]))
        fits[part] = enough
    return fits


def traverse(one: Tree, two: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that the nodes above and their own bitmaps let through; of a tree with itself each pair once."""
    top = max(len(one.levels), len(two.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        a, b = (t.levels[min(level, len(t.levels) - 1)] for t in (one, two))
        if level < top:
            grid = np.arange(FANOUT)
            if level < len(one.levels) - 1:
                i, j = (i[:, None] * FANOUT + grid).ravel(), np.repeat(j, FANOUT)
                inside = i < len(a[1])
                i, j = i[inside], j[inside]
            if level < len(two.levels) - 1:
                i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + grid).ravel()
                inside = j < len(b[1])
                i, j = i[inside], j[inside]
            if one is two:
                i, j = i[i <= j], j[i <= j]
        fits = _reach(a, b, i, j, percent)
        i, j = i[fits], j[fits]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    return (i[i < j], j[i < j]) if one is two else (i, j)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, known: list, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between sets `left` and `right` (None: among `left`), joining what `known` does not join yet."""
    def ordered(numbers: np.ndarray) -> np.ndarray:
        return numbers[np.argsort([len(sets[k]) for k in numbers], kind="stable")]

    longest = max((len(s) for s in sets), default=1)
    log_bits = min(max(int(8 * longest).bit_length(), 10), 14)
    left = ordered(left)
    one = Tree([sets[k] for k in left], log_bits)
    two = one
    if right is None:
        right = left
    else:
        right = ordered(right)
        two = Tree([sets[k] for k in right], log_bits)
    root = {k: k for k in known}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    i, j = traverse(one, two, percent)
    for x, y in zip(left[i].tolist(), right[j].tolist()):
        a, b = find(known[x]), find(known[y])
        if a == b:
            continue
        s, t = sets[x], sets[y]
        if len(s) > len(t):
            s, t = t, s
        at = np.minimum(np.searchsorted(t, s), len(t) - 1)
        both = int((t[at] == s).sum())
        if (100 + percent) * both >= percent * (len(s) + len(t)):
            root[b] = a
            out.append((x, y))
    return out


def _read(table: pa.Table, name: str = "shingles") -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in table.column(name).to_pylist()]


_NAMED = "content binary, component binary"


def _named(names: list, pairs: list[tuple[int, int]], first: int | None = None) -> list:
    """The component of every set: the name of its smallest set, or of set `first` where that is in it."""
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        root[find(y)] = find(x)
    least: dict[int, bytes] = {}
    for k, name in enumerate(names):
        least[find(k)] = min(least.get(find(k), name), name)
    if first is not None:
        least[find(first)] = names[first]
    return [least[find(k)] for k in range(len(names))]


def small_families(members: DataFrame, percent: int, read: Callable[[pa.Table], list[np.ndarray]] = _read) -> DataFrame:
    """(content, component) in families that fit one task each, many families to a task; `read` makes the sets of the rows,
    which may repeat."""

    def solve(table: pa.Table) -> pa.Table:
        once = {name: k for k, name in reversed(list(enumerate(table.column("content").to_pylist())))}
        table = table.take(sorted(once.values()))
        names, sets = table.column("content").to_pylist(), read(table)
        _, family = np.unique(np.array([str(f) for f in table.column("family").to_pylist()]), return_inverse=True)
        order, pairs = np.argsort(family, kind="stable"), []
        cuts = np.flatnonzero(np.diff(family[order], prepend=-1))
        for own in np.split(order, cuts[1:]):
            part = [sets[k] for k in own]
            at = np.arange(len(own))
            pairs += [(own[x], own[y]) for x, y in links(part, at, None, list(range(len(own))), percent)]
        return pa.table({"content": pa.array(names, pa.binary()), "component": pa.array(_named(names, pairs), pa.binary())})

    groups = max(1, -(-members.count() // CELL))
    return members.groupBy(F.pmod(F.xxhash64("family"), F.lit(groups))).applyInArrow(solve, _NAMED)


def _bitmap() -> Column:
    """Bits of the set's elements as an array of longs."""

    @F.arrow_udf("array<long>")
    def bits(values: pa.Array) -> pa.Array:
        def one(b: pa.Buffer) -> np.ndarray:
            out = np.zeros(64 * LONGS, bool)
            out[(np.frombuffer(b, np.uint64) % np.uint64(64 * LONGS)).astype(np.int64)] = True
            return np.packbits(out).view(np.int64)

        return pa.array([one(b.as_buffer()) for b in values], pa.list_(pa.int64()))

    return bits("shingles")


def _nodes(members: DataFrame, cell: str) -> DataFrame:
    """A node per cell: OR of the bitmaps, sizes, most elements on shared bits, and the component if there is just one."""
    return members.groupBy("family", cell).agg(
        *[F.bit_or(F.col("bits")[i]).alias(f"b{i}") for i in range(LONGS)], F.min("n_shingles").alias("low"),
        F.max("n_shingles").alias("high"), F.max("spare").alias("spare"),
        F.min("component").alias("c1"), F.max("component").alias("c2"))


def large_families(members: DataFrame, weights: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(content, component) in families of more than CELL sets, as far as cells and pivots tell; and the links (a, b) between such
    components, if there can be any."""
    placed = position(members, ["family"], ["n_shingles", "content"], "_at")
    placed = keep(placed.withColumn("cell", F.floor((F.col("_at") - 1) / CELL)).drop("_at"), "cells")
    pivots = members.select("content", "family").join(weights, "content").groupBy("family").agg(
        F.max_by("content", F.struct("_n", "content")).alias("content"))
    pivot_sets = members.select("content", "shingles").join(pivots, "content").select("family", "content", "shingles")
    with_pivot = placed.select("family", "cell").distinct().join(pivot_sets, "family").select("family", "cell", "content", "shingles")

    def within(table: pa.Table) -> pa.Table:
        # the pivot comes first; in its own cell its second row is left out of the traversal
        table = table.sort_by([("pivot", "descending")])
        names, sets = table.column("content").to_pylist(), _read(table)
        others = np.array([k for k in range(1, len(names)) if names[k] != names[0]], np.int64)
        known = list(range(len(names)))
        # the pivot's links first, so that what it joins is never compared again
        pairs = links(sets, np.array([0]), others, known, percent) if len(others) else []
        for _, y in pairs:
            known[y] = 0
        pairs += links(sets, others, None, known, percent) + [(0, k) for k in range(1, len(names)) if names[k] == names[0]]
        found = _named(names, pairs, 0)
        return pa.table({"content": pa.array(names[1:], pa.binary()), "component": pa.array(found[1:], pa.binary())})

    columns = ["family", "cell", "content", "shingles"]
    both = with_pivot.withColumn("pivot", F.lit(1)).unionByName(placed.select(*columns).withColumn("pivot", F.lit(0)))
    inner = keep(both.groupBy("family", "cell").applyInArrow(within, _NAMED), "cell-links")
    named = placed.join(inner, "content").withColumn("bits", _bitmap())
    named = keep(named.withColumn("spare", F.col("n_shingles") - F.aggregate("bits", F.lit(0), lambda total, x: total + F.bit_count(x))), "named-cells")
    main = named.groupBy("family", "component").agg(F.count(F.lit(1)).alias("_n")).groupBy("family").agg(
        F.max_by("component", F.struct("_n", "component")).alias("main"))
    loose = named.join(main, "family").where("component <> main").drop("main", "cell")
    if loose.isEmpty():
        return inner, None
    loose = position(loose, ["family"], ["component", "n_shingles", "content"], "_at")
    loose = keep(loose.withColumn("own", F.floor((F.col("_at") - 1) / CELL)).drop("_at"), "loose-sets")
    one, two = _nodes(loose, "own"), _nodes(named, "cell")
    renamed = two.select("family", "cell", *[F.col(c).alias(f"x_{c}") for c in two.columns if c not in ("family", "cell")])
    common = sum((F.bit_count(F.col(f"b{i}").bitwiseAND(F.col(f"x_b{i}"))) for i in range(LONGS)), F.least("spare", "x_spare"))
    reach = (
        (100 * F.col("high") >= percent * F.col("x_low")) & (100 * F.col("x_high") >= percent * F.col("low"))
        & (100 * common >= percent * F.greatest("low", "x_low")) & ((100 + percent) * common >= percent * (F.col("low") + F.col("x_low")))
        & ~((F.col("c1") == F.col("c2")) & (F.col("x_c1") == F.col("x_c2")) & (F.col("c1") == F.col("x_c1"))))
    pairs = keep(one.join(renamed, "family").where(reach).select("family", "own", "cell"), "cell-pairs")
    columns = ["family", "own", "cell", "content", "component", "shingles"]
    sides = (
        loose.join(pairs, ["family", "own"]).select(*columns).withColumn("left", F.lit(True)).unionByName(
            named.join(pairs, ["family", "cell"]).select(*columns).withColumn("left", F.lit(False))))

    def across(table: pa.Table) -> pa.Table:
        sets, side, known = _read(table), table.column("left").to_numpy(zero_copy_only=False), table.column("component").to_pylist()
        found = links(sets, np.flatnonzero(side), np.flatnonzero(~side), known, percent)
        return pa.table({c: pa.array([known[p[n]] for p in found], pa.binary()) for n, c in enumerate("ab")})

    # links between components, not between sets
    return inner, keep(sides.groupBy("family", "own", "cell").applyInArrow(across, "a binary, b binary").distinct(), "component-links")


def joined_families(inner: DataFrame, met: DataFrame | None) -> DataFrame:
    """(content, component) of both parts of `large_families`."""
    if met is None:
        return inner
    merged = components(met).select(F.col("node").alias("component"), F.col("component").alias("_whole"))
    return inner.join(merged, "component", "left").select("content", F.coalesce("_whole", "component").alias("component"))


def near_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest doc_id reachable over links."""
    rows = keep(_keyed(docs, percent), "keyed-texts")
    nodes = rows.where("n_shingles > 0").groupBy("content").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n"), F.first("keys").alias("keys"))
    nodes = keep(nodes.withColumn("node", F.xxhash64("content")), "sets")
    families = keep(_families(nodes).join(nodes.select("node", "content"), "node").select("content", "family"), "families")
    texts = one_text_each(docs, rows.select("doc_id", "row_hash", "content"), families)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                sets = list(shingle_sets(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [_digests(sets), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["content", "n_shingles", "shingles"])

    made = texts.mapInArrow(again, "content binary, n_shingles long, shingles binary").dropDuplicates(["content"])
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("many"))
    members = keep(made.join(families.join(sizes, "family"), "content"), "family-sets")
    linked = small_families(members.where(F.col("many") <= CELL), percent)
    large = members.where(F.col("many") > CELL).drop("many")
    if not large.isEmpty():
        linked = linked.union(joined_families(*large_families(large, nodes.select("content", "_n"), percent)))
    named = nodes.join(linked, "content", "left").select("content", "first", "_n", F.coalesce("component", "content").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = keep(named.join(least, "component").select("content", "component_id", "_n"), "set-names")
    out = attach(rows.select("doc_id", "n_shingles", "content"), names, "content")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
