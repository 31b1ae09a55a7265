"""Ranked lexical search by MaxScore with pair bounds.

Terms are maximal runs of ASCII letters, digits and other than ASCII characters, A-Z in lower case; a null text has none. With N the
documents that have terms, L all their terms, n a document's terms, df the documents that hold a term and tf how often one does:
w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, a term's impact is w * ((10^9 tf) div (1000 tf + 20 m)), and a
document's score the sum over the item's terms, once each.

The items come in blocks of at most QUERY_TERMS terms, each small enough for one task; per block the documents are scanned
once for postings of its terms. Postings lie in blocks of BLOCK documents. The index keeps for every block and item the largest impact of
each term, and for each pair of the item's terms (rarest two, next two, ...) the joint maximum over the pair's intersection
list, the documents that hold both. A document in a block gets from a pair at most the largest of the three, mostly far
less than the two terms' maxima together. The sums of these bounds decide, at query time, which blocks an item needs at
all (those that can reach the k-th score of its most promising blocks), and within a block which pairs must be read for all
documents and which only for candidates. Bounds never cut a score that could rank, equal scores included.

Repeated rows are documents of their own; a null doc_id ranks last among equals. Rows of one item id are one item. Items without
terms and empty tables give no rows; other columns are not read. Very long texts are read whole, in slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from curatorium.llm import words
from curatorium.llm.bpe import slices
from curatorium.llm.phrases import cut_out
from curatorium.llm.store import keep
from curatorium.operators.ordered import first_k

TOP, BLOCK, SEEDS = 50, 1024, 2
QUERY_TERMS = 20_000  # (item, term) pairs of a block of items

_TERM = np.full(256, 32, np.uint8)
_TERM[48:58], _TERM[65:91], _TERM[97:123] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts = words.raw(texts)
    return _TERM[data], starts


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), each once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                data, starts = _folded(part.column("text"))
                begin, end = words.spans(data, starts)
                of = np.searchsorted(starts[1:], begin, "right")
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(of)), cut_out(data, begin, end)], names=["item", "term"])

    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(split, StructType([rows.schema["item"], StructField("term", rows.schema["text"].dataType)])).distinct()


class Vocabulary:
    """The terms of a block of items; a hash finds the place, the bytes decide."""

    def __init__(self, terms: list[str]):
        column = pa.array(terms, pa.large_string())
        self.data, starts = _folded(column)
        self.begin, self.size = starts[:-1], np.diff(starts)
        hashes = words.word_hashes(self.data, starts)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of one block of items share a hash; use another QUERY_TERMS")

    def find(self, data: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and of which."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[hit]]
        begin, end = words.spans(data, starts)
        begin, size = begin[hit], (end - begin)[hit]
        same = size == self.size[term]
        hit, term, begin, size = hit[same], term[same], begin[same], size[same]
        if not len(hit):
            return hit, term
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        inner = np.arange(size.sum()) - np.repeat(first, size)
        equal = data[inner + np.repeat(begin, size)] == self.data[inner + np.repeat(self.begin[term], size)]
        same = np.logical_and.reduceat(equal, first)
        return hit[same], term[same]


def postings(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(block, doc_id, n, terms, tfs) of every document that has a term at all; terms are numbers in the vocabulary."""
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, known = TaskContext.get().partitionId(), 0, given.value
        for whole in batches:
            for piece in slices(whole, "text"):
                data, starts = _folded(piece.column("text"))
                hashes, first = words.word_hashes(data, starts)
                counts = np.diff(first)
                hit, term = known.find(data, starts, hashes)
                doc = np.searchsorted(first, hit, "right") - 1
                size = len(known.hashes)
                pairs, tfs = np.unique(doc * size + term, return_counts=True)
                rows = np.flatnonzero(counts)
                ends = np.searchsorted(pairs // size, np.arange(len(counts) + 1))
                offsets = pa.array(np.append(ends[rows], ends[-1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array((part << 32) + (seen + np.arange(len(rows))) // block), piece.column("doc_id").take(pa.array(rows)),
                    pa.array(counts[rows]), pa.ListArray.from_arrays(offsets, pa.array((pairs % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int64)))], names=["block", "doc_id", "n", "terms", "tfs"])
                seen += len(rows)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "block long, doc_id long, n long, terms array<int>, tfs array<long>")


def _frequencies(posted: DataFrame, size: int) -> np.ndarray:
    """Of every term the number of documents that hold it; one row a term and task, then one a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in posted.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Search:
    """One block of items over all documents: what tasks need to score."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int):
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        # rarest first; pairs of neighbours, the last term of an odd number alone
        self.items = [own[np.lexsort((own, -weights[own]))] for own in items]

    def lists(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one block's rows: where each term's list begins, the places of its documents, and its impacts there."""
        terms = table.column("terms").combine_chunks()
        sizes = pc.list_value_length(terms).to_numpy()
        term, tf = terms.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
        place = np.repeat(np.arange(len(sizes)), sizes)
        m = 50 + 50 * table.column("n").to_numpy() * self.n_docs // self.n_terms
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[place]))
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.weights) + 1)), place[order], impact[order]

    def units(self, item: np.ndarray, lists: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest impact of the first and the second term of each pair, and the pair's joint maximum (0 if no document has both)."""
        starts, place, impact = lists
        dense = np.zeros((len(item) + len(item) % 2, size), np.int64)
        for row, t in enumerate(item):
            dense[row, place[starts[t] : starts[t + 1]]] = impact[starts[t] : starts[t + 1]]
        one, two = dense[0::2], dense[1::2]
        return one.max(1), two.max(1), np.where((one > 0) & (two > 0), one + two, 0).max(1)

    def best(self, item: np.ndarray, bounds: np.ndarray, lists: tuple, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that score `least` or more; bounds are those of the item's pairs."""
        starts, place, impact = lists
        order = np.argsort(bounds, kind="stable")
        upto = np.cumsum(bounds[order])
        scores = np.zeros(size, np.int64)
        needed = int(np.searchsorted(upto, least))  # pairs before it can't reach `least` together
        own = [[t for t in item[2 * u : 2 * u + 2]] for u in order]
        for pair in own[needed:]:
            for t in pair:
                scores[place[starts[t] : starts[t + 1]]] += impact[starts[t] : starts[t + 1]]
        open_ = np.flatnonzero(scores)
        for u in range(needed - 1, -1, -1):
            open_ = open_[scores[open_] + upto[u] >= least]
            if not len(open_):
                break
            for t in own[u]:
                held = place[starts[t] : starts[t + 1]]
                at = np.minimum(np.searchsorted(held, open_), max(len(held) - 1, 0))
                hit = held[at] == open_ if len(held) else np.zeros(len(open_), bool)
                scores[open_[hit]] += impact[starts[t] : starts[t + 1]][at[hit]]
        open_ = open_[scores[open_] >= least]
        return open_, scores[open_]


_INDEX = "block long, item int, one array<long>, two array<long>, both array<long>"


def pair_index(posted: DataFrame, search: Search) -> DataFrame:
    """One row per block and item with any of its terms there: the maxima of its terms and of its pairs' intersection lists."""
    given = posted.sparkSession.sparkContext.broadcast(search)

    def build(table: pa.Table) -> pa.Table:
        own = given.value
        rows: dict[str, list] = {name: [] for name in ("block", "item", "one", "two", "both")}
        lists, block = own.lists(table), table.column("block")[0].as_py()
        for number, item in enumerate(own.items):
            one, two, both = own.units(item, lists, table.num_rows)
            if one.any() or two.any():
                for name, value in zip(rows, (block, number, one, two, both)):
                    rows[name].append(value)
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
        return pa.table({name: pa.array(v, k) for (name, v), k in zip(rows.items(), kinds)})

    return posted.groupBy("block").applyInArrow(build, _INDEX)


def _scored(posted: DataFrame, wanted: DataFrame, search: Search, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): of every wanted (block, item, bounds) its k best documents that score `least` or more."""
    given = posted.sparkSession.sparkContext.broadcast((search, least))

    def solve(table: pa.Table, asked: pa.Table) -> pa.Table:
        own, floor = given.value
        out: list[tuple] = []
        if table.num_rows and asked.num_rows:
            lists = own.lists(table)
            ids = table.column("doc_id")
            late = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            for number, bounds in zip(asked.column("item").to_pylist(), asked.column("bounds").to_pylist()):
                at, scores = own.best(own.items[number], np.array(bounds, np.int64), lists, table.num_rows, max(int(floor[number]), 1))
                chosen = np.lexsort((late[at], -scores))[:k]
                out.append((number, at[chosen], scores[chosen]))
        if not out:
            return pa.table({"item": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.table({
            "item": pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int32)),
            "doc_id": ids.take(pa.array(np.concatenate([o[1] for o in out]))).combine_chunks(),
            "score": pa.array(np.concatenate([o[2] for o in out]))})

    return posted.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(solve, "item int, doc_id long, score long")


def _bounded(index: DataFrame) -> DataFrame:
    """The index with each pair's bound, and their sum."""
    pairs = F.zip_with(F.zip_with("one", "two", lambda a, b: F.greatest(a, b)), "both", lambda a, b: F.greatest(a, b))
    return index.withColumn("bounds", pairs).withColumn(
        "bound", F.aggregate("bounds", F.lit(0).cast("long"), lambda total, x: total + x))


def _search(docs: DataFrame, asked: list[tuple], k: int, names: StructType, block: int) -> DataFrame:
    """Ranked documents of a block of items, given as (item, term)."""
    spark = docs.sparkSession
    terms = sorted({t for _, t in asked})
    ids = list(dict.fromkeys(i for i, _ in asked))
    number, of = {t: i for i, t in enumerate(terms)}, {i: [] for i in ids}
    for i, t in asked:
        of[i].append(number[t])
    posted = keep(postings(docs, Vocabulary(terms), block=block), "postings")
    n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = _frequencies(posted, len(terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    search = Search([np.array(of[i]) for i in ids], weights, n_docs, n_terms or 1)
    bounded = _bounded(keep(pair_index(posted, search), "pair-index")).where("bound > 0")
    # the k-th score in each item's most promising blocks is one that every ranked document must reach
    seeds = first_k(bounded, ["item"], [F.desc("bound"), F.asc("block")], SEEDS).select("block", "item", "bounds")
    seeds = keep(seeds, "seeds")
    near = posted.join(F.broadcast(seeds.select("block").distinct()), "block", "left_semi")  # at most SEEDS an item
    found = first_k(_scored(near, seeds, search, np.zeros(len(ids), np.int64), k), ["item"], [F.desc("score")], k)
    least = np.zeros(len(ids), np.int64)
    for r in found.where(F.col("position") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    floor = spark.createDataFrame([(i, int(x)) for i, x in enumerate(least)], "item int, _least long")
    reach = bounded.join(F.broadcast(floor), "item").where(F.col("bound") >= F.col("_least")).select("block", "item", "bounds")
    ranked = first_k(_scored(posted, reach, search, least, k), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    named = spark.createDataFrame(
        list(enumerate(ids)), StructType([StructField("item", IntegerType()), StructField("item_id", names["item"].dataType)]))
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item the k documents of highest score above 0, equal scores by ascending doc_id."""
    asked = keep(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // query_terms))
    placed = asked.withColumn("_in", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = None
    for chosen in range(blocks):
        rows = [(r["item"], r["term"]) for r in placed.where(F.col("_in") == chosen).collect()]
        if rows:
            part = _search(docs, rows, k, asked.schema, block)
            out = part if out is None else out.union(part)
    empty = StructType([StructField("item_id", asked.schema["item"].dataType)])
    return out if out is not None else docs.sparkSession.createDataFrame([], empty).selectExpr(
        "item_id", "cast(null as int) rank", "cast(null as long) doc_id", "cast(null as long) score")
