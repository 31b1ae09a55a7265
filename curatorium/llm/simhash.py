"""Near-duplicates by SimHash: pigeonhole blocks, a join on blocks, then the Hamming distance.

Texts: ASCII letters in lower case, words are runs without ASCII white space, 4-word shingles with repeats. A bit of the
fingerprint is 1 if it is set in more than half of the shingles' XXH64 (seed 42). Null and wordless texts have fingerprint zero
and link like others; a text of fewer than 4 words is one shingle. Fingerprints link at `max_bits` or fewer differing bits.

With B blocks, two fingerprints within d bits agree in at least B - d blocks, so each choice of B - d blocks is a join key and no
pair is lost. B follows the number of distinct fingerprints (a wider key for more of them), which changes the work, never the links.

Rows with equal fingerprints are joined through the fingerprint, never in pairs. Blocks shared by many different fingerprints
are cut into cells of bounded size; a cell returns a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from curatorium.llm import words
from curatorium.llm.components import components
from curatorium.llm.store import keep

SEED = 42
CROWD = 128  # different fingerprints of a block that are still joined row by row
CELL = 4096  # fingerprints from each side that meet in one cell of a larger block
STEP = 1 << 16


def simhash(text: bytes, size: int = 4) -> int:
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(found))
    total = len(found) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, STEP):
        spans = zip(starts[at : min(at + STEP, total)].tolist(), ends[at + size - 1 : min(at + STEP, total) + size - 1].tolist())
        values = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8")
        bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64)
        even = len(bits) // 255 * 255  # so many bits add up within a byte
        ones += bits[:even].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[even:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    encoded = (t for part in words.parts(texts) for t in part.cast(pa.large_binary()).to_pylist())
    values = np.fromiter((simhash(t) if t else 0 for t in encoded), np.uint64, len(texts))
    return pa.array(values.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The 64 bits as a long."""
    return _fingerprints(text)


def _blocks(count: int, max_bits: int) -> int:
    """The fewest blocks whose keys tell `count` fingerprints apart on average."""
    for blocks in range(max_bits + 2, 64):
        if 64 * (blocks - max_bits) / blocks >= np.log2(max(count, 2)) or len(list(combinations(range(blocks), max_bits))) > 200:
            return blocks
    return 63


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Bits of every choice of blocks that must agree, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(choice) for choice in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(max_bits: int):
    """Links of one cell, thinned to a forest with the same components."""

    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(cell["fp"].to_numpy(np.int64)).view(np.uint64)
        open_, out = np.arange(len(values)), []
        while len(open_):
            # spread from the first value that no tree holds yet
            front, open_ = open_[:1], open_[1:]
            while len(front) and len(open_):
                at, front = front[0], front[1:]
                near = np.bitwise_count(values[open_] ^ values[at]) <= max_bits
                found, open_ = open_[near], open_[~near]
                out += [(values[at], values[f]) for f in found]
                front = np.concatenate([front, found])
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return solve


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links (a, b) between the distinct values of `fp` whose components are those of all pairs within `max_bits`."""
    prints = keep(prints.select("fp").where("fp is not null").distinct(), "prints")
    masks = block_masks(_blocks(prints.count(), max_bits), max_bits)
    shared = Window.partitionBy("table", "key")
    keyed = keep(
        prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
        .withColumn("many", F.count(F.lit(1)).over(shared)).where("many > 1"), "blocks")
    plain = keyed.where(F.col("many") <= CROWD).drop("many")
    met = (
        plain.withColumnRenamed("fp", "a").join(plain.withColumnRenamed("fp", "b"), ["table", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct())
    slices = F.ceil(F.col("many") / CELL).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    cells = (
        keyed.where(F.col("many") > CROWD).withColumn("slices", slices).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}))
    crowded = cells.groupBy("table", "key", "i", "j").applyInPandas(_forest(max_bits), "a long, b long")
    return met.union(crowded)


def near_duplicates(docs: DataFrame, max_bits: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, fp, component_id): component_id is the smallest key among all rows reachable over links, null if all are null.

    Repeated keys stay separate rows. Other columns are not read."""
    prints = keep(docs.select(F.col(key), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    groups = components(links(prints, max_bits)).select(F.col("node").alias("fp"), "component")
    firsts = prints.groupBy("fp").agg(F.min(key).alias("_first")).join(groups, "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    smallest = firsts.groupBy("component").agg(F.min("_first").alias("component_id"))
    named = firsts.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """Documents without those that link, over any chain, to a document of smaller id. Of rows that share the smallest id
    all stay; null ids stay only where their whole group has none."""
    found = near_duplicates(docs, max_bits)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
