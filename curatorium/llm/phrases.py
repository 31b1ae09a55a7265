"""Phrase collocations by prefix-free parsing.

Texts (null: empty) take ASCII letters in lower case, are split at `.,;:!?` and line ends into pieces, and those into words, runs
without blank or tab. A piece is parsed into chunks at positions that the text itself chooses: where a hash of OVERLAP words
hits a fixed remainder. A chunk reaches from one such position over the next one's OVERLAP words, so neighbours overlap, equal
passages give equal chunks wherever they stand, and the distinct chunks with their numbers of occurrences hold the whole corpus.

Phrases are counted inside the distinct chunks, each weighted by its occurrences. A phrase counts in the chunk where it begins: all
beginnings before the overlap, and in a piece's last chunk those in the overlap too. So every occurrence counts once, for phrases
of up to OVERLAP + 1 words. Phrases grow by a word a pass; one is counted only if both its shorter parts passed the threshold,
as far as a bit table of bounded size can tell. The table never drops a frequent phrase; where it is too small for a corpus
it lets more rare ones through, which the exact count then drops.

Everything is per language (null: `und`). Empty texts and tables give no rows; repeated rows count as often as they stand; other
columns are not read; ties are ordered by the phrase's bytes. Very long texts are parsed in slices of whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from curatorium.llm import words
from curatorium.llm.bpe import slices
from curatorium.llm.store import keep
from curatorium.operators.bounded import small_or_shuffled
from curatorium.operators.ordered import first_k

OVERLAP, LONGEST = 4, 5
EVERY = 16  # one position in so many ends a chunk
LEAST, TOP = 100, 2000
LOG_BITS, LOG_ROW = 26, 16  # 8 MB of bits in rows of 8 KB
_GROUP = 8 << 20

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 10
_PLAIN[9] = 32


def cut_out(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings data[begin:end]."""
    sizes = end - begin
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
    taken = np.ascontiguousarray(data[at])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from every position; those over the end mean nothing."""
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        total = total * np.uint64(words._BASE) + padded[j : j + len(hashes)]
    return words.mix(total)


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all texts: the text's number, whether the chunk ends its piece, and the chunk with one blank between words."""
    data, starts = words.raw(texts)
    data = _PLAIN[data]
    hashes, first = words.word_hashes(data, starts)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, bool), pa.array([], pa.string())
    begin, end = words.spans(data, starts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(len(hashes), bool)
    new[1:] = (breaks[begin[1:]] != breaks[begin[:-1]]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    piece = np.cumsum(new) - 1
    tail = np.append(heads[1:], len(hashes))[piece]  # where each word's piece ends
    at = np.arange(len(hashes))
    opens = new | ((_runs(hashes, OVERLAP) % np.uint64(EVERY) == 0) & (at + OVERLAP <= tail))
    a = np.flatnonzero(opens)
    after = np.append(a[1:], len(hashes))
    last = after >= tail[a]
    b = np.where(last, tail[a], after + OVERLAP)
    # the chunks' words side by side, each with the byte after it made a blank, the last of a chunk without
    sizes = b - a
    ends = np.cumsum(sizes)
    word = np.arange(ends[-1]) + np.repeat(a - (ends - sizes), sizes)
    width = end[word] - begin[word] + 1
    width[ends - 1] -= 1
    stop = np.cumsum(width)
    byte = np.arange(stop[-1]) + np.repeat(begin[word] - (stop - width), width)
    out = np.append(data, np.uint8(32))[byte]
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    out[stop[inner] - 1] = 32
    offsets = np.concatenate([[0], stop[ends - 1]])
    strings = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return text[a], last, strings


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, last, chunk, n): the distinct chunks and how often each stands."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                of, last, found = chunks(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(of)), pa.array(last), found], names=["lang", "last", "chunk"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    parsed = rows.mapInArrow(parse, "lang string, last boolean, chunk string")
    return parsed.groupBy("lang", "last", "chunk").agg(F.count(F.lit(1)).alias("n"))


def _gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """Batches put together up to _GROUP bytes, so that equal phrases meet before they leave the task."""
    held, size = [], 0
    for whole in batches:
        for part in slices(whole, text):
            held.append(part)
            size += part.nbytes
            if size >= _GROUP:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lang_keys(langs: pa.Array) -> np.ndarray:
    coded = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    coded = coded.dictionary_encode()
    keys = np.array([xxhash.xxh64_intdigest(v.encode()) for v in coded.dictionary.to_pylist()] or [0], np.uint64)
    return keys[coded.indices.to_numpy(zero_copy_only=False)]


def _places(hashes: np.ndarray, log_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - log_bits)).astype(np.int64)


def _table(frequent: DataFrame, log_bits: int) -> np.ndarray:
    """One bit set for every (lang, phrase): at most 2^log_bits bits reach the driver, whatever the number of phrases."""
    log_row = min(LOG_ROW, log_bits)

    @F.pandas_udf("long")
    def place(langs: pd.Series, phrases: pd.Series) -> pd.Series:
        hashes, first = words.word_hashes(*words.raw(pa.array(phrases, pa.large_string())))
        keys, out = _lang_keys(pa.array(langs, pa.string())), np.zeros(len(phrases), np.uint64)
        counts = np.diff(first)
        for size in np.unique(counts):
            own = counts == size
            out[own] = words.mix(_runs(hashes, int(size))[first[:-1][own]] ^ keys[own])
        return pd.Series(_places(out, log_bits))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << log_row, bool)
        bits[group["place"].to_numpy() & ((1 << log_row) - 1)] = True
        return pd.DataFrame({"row": [group["place"].iloc[0] >> log_row], "bits": [np.packbits(bits).tobytes()]})

    rows = frequent.select(place("lang", "phrase").alias("place")).distinct().groupBy(
        F.shiftright("place", log_row)).applyInPandas(pack, "row long, bits binary").collect()
    out = np.zeros(1 << log_bits, bool)
    for r in rows:
        out[r["row"] << log_row : (r["row"] + 1) << log_row] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return np.packbits(out)


def counted(parsed: DataFrame, size: int, shorter: DataFrame | None = None, log_bits: int = LOG_BITS) -> DataFrame:
    """(lang, phrase, f) of the phrases of `size` words in the dictionary; with `shorter`, only of those whose two parts of a word
    less are among its phrases, as far as the bit table tells."""
    table = None if shorter is None else parsed.sparkSession.sparkContext.broadcast(_table(shorter, log_bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(batches, "chunk"):
            data, starts = words.raw(group.column("chunk"))
            hashes, first = words.word_hashes(data, starts)
            sizes = np.diff(first)
            text = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(len(hashes)) - first[text]
            last = group.column("last").to_numpy()
            stop = np.where(last, sizes - size + 1, np.minimum(sizes - OVERLAP, sizes - size + 1))
            at = np.flatnonzero(inside < stop[text])
            langs = _lang_keys(group.column("lang"))
            if table is not None:
                bits, parts = table.value, _runs(hashes, size - 1)
                for shift in (0, 1):
                    place = _places(words.mix(parts[at + shift] ^ langs[text[at]]), log_bits)
                    at = at[(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
            if not len(at):
                continue
            key = words.mix(_runs(hashes, size)[at] ^ langs[text[at]])
            second = _runs(words.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), size)[at]
            order = np.argsort(key, kind="stable")
            at, key, second = at[order], key[order], second[order]
            # two phrases under one key are kept apart by the second hash; a phrase in two rows is summed later
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1]) | (langs[text[at[1:]]] != langs[text[at[:-1]]])
            heads = np.flatnonzero(new)
            weight = group.column("n").to_numpy()
            begin, end = words.spans(data, starts)
            one = at[heads]
            yield pa.RecordBatch.from_arrays(
                [group.column("lang").combine_chunks().take(pa.array(text[one])), cut_out(data, begin[one], end[one + size - 1]),
                 pa.array(np.add.reduceat(weight[text[at]], heads))], names=["lang", "phrase", "f"])

    rows = parsed.select("lang", "last", "chunk", "n").mapInArrow(count, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP, log_bits: int = LOG_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), each language's first `top` phrases (all for None) by score, a and phrase.

    Phrases of 2 to 5 words that stand at least `least` times. The score is floor(1000 a n / (l r)) at the cut into two parts, standing
    l and r times, where it is lowest, the first such cut counting; n is the language's number of words. Phrases that
    stand only inside one longer candidate are left out."""
    parsed = keep(dictionary(docs), "chunks")
    single = keep(counted(parsed, 1), "words")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    level = single.where(F.col("f") >= least).withColumn("size", F.lit(1))
    frequent = level
    for size in range(2, LONGEST + 1):
        level = keep(counted(parsed, size, level, log_bits).where(F.col("f") >= least).withColumn("size", F.lit(size)), f"phrases-{size}")
        frequent = frequent.union(level)
    wide = frequent.where("size > 1").withColumn("words", F.split("phrase", " "))
    longer = (
        wide.where("size > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
        .select("lang", _part(F.col("i"), F.col("k")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("inside")))
    free = wide.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("inside") < F.col("f"), F.lit(True)))
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", _part(1, F.col("k")).alias("_left"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    for side in ("l", "r"):
        name = {"l": "_left", "r": "_right"}[side]
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(side)), ["lang", name])
    exact = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.join(small_or_shuffled(totals), "lang").withColumn("score", exact)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select(
        "lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    if top is None:
        return best
    ranked = first_k(best, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
