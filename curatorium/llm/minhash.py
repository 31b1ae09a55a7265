"""Document fingerprints by MinHash.

Whole texts (null: empty), words are runs without ASCII white space, shingles of five words (a shorter text is one shingle, a
text without words has none and the all-ones fingerprint). 128 universal hash functions (multiply, add, high half of 64
bits) permute the shingles' hashes; of each minimum the fingerprint keeps the lowest 8 bits. Two fingerprints of likeness J
agree in about J + (1 - J) / 256 of the bytes; `likeness` corrects for that. Equal texts have equal fingerprints.

`near_duplicates` joins bands of five bytes and verifies the Jaccard likeness of what they bring together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from curatorium.llm import sigtree, simhash, words
from curatorium.llm.bpe import slices
from curatorium.llm.components import components
from curatorium.llm.sigtree import small_families
from curatorium.llm.store import attach, keep, parts_for
from curatorium.operators.bounded import small_or_shuffled

SHINGLE, HASHES, SEED = 5, 128, 20_240_229
_STEP = 1 << 14  # shingles hashed at a time; fits the processor's cache


def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(SEED))
    draw = random.integers(0, 1 << 63, (2, hashes), np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0], draw[1]


def minima(values: np.ndarray, starts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Per text (one column each) the least value of every hash function; all ones where a text has no shingle."""
    times, plus = _functions(hashes)
    out = np.full((hashes, len(starts) - 1), np.iinfo(np.uint64).max, np.uint64)
    scratch = np.empty(_STEP, np.uint64)
    filled = np.flatnonzero(np.diff(starts))
    begins = starts[:-1][filled]
    for at in range(0, len(values), _STEP):
        part = values[at : at + _STEP]
        # texts that reach into this part; the first may have begun before it
        left, right = int(np.searchsorted(begins, at, "right")) - 1, int(np.searchsorted(begins, at + len(part)))
        offsets, texts, room = np.maximum(begins[left:right] - at, 0), filled[left:right], scratch[: len(part)]
        for k in range(hashes):
            np.multiply(part, times[k], out=room)
            np.add(room, plus[k], out=room)
            out[k, texts] = np.minimum(out[k, texts], np.minimum.reduceat(room, offsets))
    return out


def signatures(texts: pa.Array, hashes: int = HASHES) -> np.ndarray:
    """One row of `hashes` bytes per text."""
    data, starts = words.raw(texts)
    rows = [np.zeros((0, hashes), np.uint8)]
    for a, b in words.blocks(starts):
        hashed, first = words.word_hashes(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        least = minima(*words.shingle_hashes(hashed, first, SHINGLE), hashes)
        rows.append(((least >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).T)
    return np.concatenate(rows)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness, row by row."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _row_hashes(texts: list[str]) -> pa.Array:
    """Spark's xxhash64 of the texts."""
    return pa.array(np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in texts], np.uint64).view(np.int64), pa.int64())


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double, content binary, row_hash long")


def _compare(ids: list, texts: list[str], nexts: list[str], prints: np.ndarray, next_prints: np.ndarray) -> dict[str, pa.Array]:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
    changed = pa.array(edited, pa.large_string())
    edited_prints = signatures(changed)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": _binary(prints), "edited_fingerprint": _binary(edited_prints),
        "near_edited": pa.array(likeness(prints, edited_prints)), "near_next": pa.array(likeness(prints, next_prints)),
        "content": pa.array([c for c, _ in _shingle_sets(pa.array(texts, pa.large_string()))], pa.binary()),
        "row_hash": _row_hashes(texts),
    }


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted partition's rows but the last; its first and last row as they are, for the joints."""
    part = TaskContext.get().partitionId()
    empty = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(),
             "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "content": pa.binary(), "row_hash": pa.int64()}

    def end(kind: str, doc_id, text: str) -> pa.RecordBatch:
        columns = {name: pa.nulls(1, t) for name, t in empty.items()} | {"doc_id": pa.array([doc_id], pa.int64())}
        return pa.RecordBatch.from_pydict(
            columns | {"kind": pa.array([kind]), "part": pa.array([part], pa.int32()), "text": pa.array([text], pa.string())})

    held, ids, texts, prints = False, [], [], None
    for whole in batches:
        for piece in slices(whole, "text"):
            own_ids, own = piece.column("doc_id").to_pylist(), [t or "" for t in piece.column("text").to_pylist()]
            if not held:
                yield end("first", own_ids[0], own[0])
            made = signatures(piece.column("text"))
            ids, texts = ids + own_ids, texts + own
            prints = np.concatenate([prints, made]) if held else made
            held = True
            if len(ids) > 1:
                rows = _compare(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_pydict(rows | {
                    "kind": pa.array(["done"] * n), "part": pa.array([part] * n, pa.int32()), "text": pa.nulls(n, pa.string())})
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
    if held:
        yield end("last", ids[0], texts[0])


def _joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, after = batch.column("text").fill_null(""), batch.column("next_text").fill_null("")
        rows = _compare(batch.column("doc_id").to_pylist(), own.to_pylist(), after.to_pylist(), signatures(own), signatures(after))
        yield pa.RecordBatch.from_pydict(rows)


def with_next(docs: DataFrame) -> DataFrame:
    """`_compared` without what only the classes need."""
    return _compared(docs).drop("content", "row_hash")


def _compared(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edit, whose last half is replaced from the start of the next text by (doc_id, text),
    null ids first and the first text following the last; then the likeness to the edit and to the next text.

    The texts are range-partitioned once and read in order; only the rows at the ends of partitions, two each, are joined.
    Repeated rows are rows of their own. Other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    n = parts_for(rows, rows.count(), 20_000)
    laid = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    made = keep(laid.mapInArrow(_inside, f"{_RESULT}, kind string, part int, text string"), "texts-in-order")
    # part numbers only: one row per partition
    order = made.where("kind = 'first'").select("part").withColumn(
        "before", F.lag("part").over(Window.orderBy("part"))).withColumn(
        "before", F.coalesce("before", F.max("part").over(Window.orderBy("part").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))))
    after = made.where("kind = 'first'").select("part", F.col("text").alias("next_text")).join(order, "part").drop("part")
    ends = made.where("kind = 'last'").select("doc_id", "text", F.col("part").alias("before")).join(after, "before")
    joints = ends.select("doc_id", "text", "next_text").mapInArrow(_joints, _RESULT)
    return made.where("kind = 'done'").select(*joints.columns).union(joints)


BANDS, ROWS = 25, 5  # a pair of likeness 0.8 misses all bands with a chance of 5 in 100,000
CROWD, FEW_CELLS = 64, 64
_HASHED = StructType([StructField("content", BinaryType()), StructField("signature", BinaryType())])


def _shingle_sets(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of every text its sorted different shingle hashes, and a digest of them."""
    data, starts = words.raw(texts)
    for a, b in words.blocks(starts):
        hashed, first = words.word_hashes(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        values, begins = words.shingle_hashes(hashed, first, SHINGLE)
        for i in range(b - a):
            own = np.unique(values[begins[i] : begins[i + 1]])
            yield hashlib.md5(own.tobytes()).digest(), own


def _hashed(fold: bool):
    @F.arrow_udf(_HASHED)
    def hashed(texts: pa.Array) -> pa.Array:
        content, prints = [], [np.zeros((0, HASHES), np.uint8)]
        for part in words.parts(texts):
            column = pc.ascii_lower(part) if fold else part
            content += [c for c, _ in _shingle_sets(column)]
            prints.append(signatures(column))
        return pa.StructArray.from_arrays([pa.array(content, pa.binary()), _binary(np.concatenate(prints))], names=_HASHED.names)

    return hashed


def jaccard(a: bytes | pa.Buffer, b: bytes | pa.Buffer) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, fold: bool = False, max_bits: int | None = None) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the smallest doc_id reachable over links of Jaccard likeness `similarity` or
    more between the texts' shingle sets; null where the whole class has none. `fold` takes ASCII letters in lower case.

    Texts of equal shingle sets are one node. Signature bands join nodes that may be alike; likeness is verified on the sets
    themselves, which are made again for those nodes only. With `max_bits`, so do SimHash classes of that many bits."""
    text = F.coalesce("text", F.lit(""))
    prints = [] if max_bits is None else [simhash.fingerprint(text).alias("fp")]
    rows = keep(docs.select("doc_id", F.xxhash64(text).alias("row_hash"), _hashed(fold)(text).alias("x"), *prints).select(
        "doc_id", "row_hash", "x.*", *(["fp"] if prints else [])), "hashed-texts")
    alike = _alike_bits(rows, max_bits) if prints else None
    return attach(rows.select("doc_id", "content"), _named(docs, rows, similarity, fold, alike), "content").select("doc_id", "class_id")


def _alike_bits(rows: DataFrame, max_bits: int) -> DataFrame:
    """(content, class) by SimHash: pigeonhole blocks, their join and the Hamming distance, of the different fingerprints."""
    prints = keep(rows.select("content", "fp").distinct(), "content-prints")
    groups = components(simhash.links(prints, max_bits)).select(F.col("node").alias("fp"), "component")
    return prints.join(groups, "fp", "left").select("content", F.coalesce("component", "fp").alias("class"))


def with_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`with_next` and class_id, that of `near_duplicates`, from the same fingerprints."""
    made = _compared(docs)
    rows = made.select("doc_id", "row_hash", "content", F.col("fingerprint").alias("signature"))
    named = _named(docs, rows, similarity, False)
    return attach(made, named, "content").drop("content", "row_hash")


def _named(docs: DataFrame, rows: DataFrame, similarity: float, fold: bool, alike: DataFrame | None = None) -> DataFrame:
    """(content, class_id, _n) for the contents of rows (doc_id, row_hash, content, signature) made of `docs`, _n being their rows.

    Bands link nodes by 64-bit names, whose collisions only bring more sets together. Sets that bands connect, over any chain,
    are a family; a family of up to CELL sets is solved in one task, and each of its texts moves there once. In larger
    families only the pairs that share a band are verified, and bands of more than CROWD sets as families of their own.
    A class of `alike` (content, class) is one more band."""
    percent = round(100 * similarity)
    nodes = keep(rows.groupBy("content").agg(
        F.min("signature").alias("signature"), F.min(F.struct("doc_id", "row_hash")).alias("row"), F.count(F.lit(1)).alias("_n"),
        F.min("doc_id").alias("_first")).withColumn("node", F.xxhash64("content")), "contents")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 1 + ROWS * i, ROWS)) for i in range(BANDS)])
    banded = nodes.select("node", F.explode(keys).alias("key"))
    if alike is not None:
        banded = banded.union(alike.select(F.xxhash64("content"), F.xxhash64(F.lit("simhash"), "class")).distinct())
    groups = banded.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("least")).where("many > 1")
    shared = keep(banded.join(groups, "key"), "bands")

    def families(edges: DataFrame, name: str) -> DataFrame:
        found = components(keep(edges.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), name))
        found = keep(found.select("node", F.col("component").alias("family")), name + "-found")
        return found.join(found.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family")

    def with_text(members: DataFrame) -> DataFrame:
        """One text of every member's content, with the member's columns."""
        chosen = keep(nodes.select("node", "content", F.col("row.doc_id").alias("_id"), F.col("row.row_hash").alias("_hash")).join(
            members, "node"), "chosen-rows")
        text = F.coalesce("text", F.lit(""))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_own"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
        return texts.join(small_or_shuffled(chosen), same).select("text", *[c for c in chosen.columns if c not in ("_id", "_hash")])

    def read(table: pa.Table) -> list[np.ndarray]:
        texts = table.column("text").combine_chunks().cast(pa.large_string())
        return [own for _, own in _shingle_sets(pc.ascii_lower(texts) if fold else texts)]

    everyone = keep(families(shared, "band-edges"), "families")
    found = small_families(with_text(everyone.where(F.col("size") <= sigtree.CELL)), percent, read)
    large = keep(shared.join(everyone.where(F.col("size") > sigtree.CELL).select("node"), "node", "left_semi"), "large-bands")
    if not large.isEmpty():
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in slices(whole, "text")):
                made = read(pa.Table.from_batches([batch]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("content"), pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())],
                    names=["node", "content", "n_shingles", "shingles"])

        bodies = with_text(large.select("node").distinct()).mapInArrow(
            sets, "node long, content binary, n_shingles long, shingles binary").dropDuplicates(["content"])
        bodies = keep(bodies, "shingle-sets")
        # crowds of one family are taken together while that is cheap; else those that share crowded bands are families of their own
        core = keep(large.where(F.col("many") > CROWD).select("node").distinct(), "crowded")
        if core.count() <= FEW_CELLS * sigtree.CELL:
            of = core.join(everyone.select("node", "family"), "node")
        else:
            of = families(large.where(F.col("many") > CROWD), "crowds").drop("size")
        crowds = bodies.join(of, "node").drop("node")
        weights = nodes.select("content", "_n")
        plain = large.where(F.col("many") <= CROWD).select("key", "node").join(bodies.select("node", F.col("n_shingles").alias("n")), "node")
        near = plain.toDF("x", "key", "x_size").join(plain.toDF("y", "key", "y_size"), "key").where(
            (F.col("x") < F.col("y")) & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))).select("x", "y").distinct()

        @F.arrow_udf(DoubleType())
        def alike(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array([jaccard(a.as_buffer(), b.as_buffer()) for a, b in zip(x, y)], pa.float64())

        one, other = (bodies.select(F.col("node").alias(n), F.col("content").alias(c), F.col("shingles").alias(c + "_set")) for n, c in (("x", "a"), ("y", "b")))
        inner, met = sigtree.large_families(crowds, weights, percent)
        crowded = inner.where("content <> component").toDF("a", "b")
        crowded = crowded if met is None else crowded.union(met)
        edges = near.join(one, "x").join(other, "y").where(alike("a_set", "b_set") >= similarity).select("a", "b").union(crowded)
        found = found.union(components(keep(edges, "minhash-links")))
    groups = keep(found, "linked-sets")
    firsts = nodes.select("content", "_first", "_n").join(groups, "content", "left").withColumn(
        "component", F.coalesce("component", "content"))
    smallest = firsts.groupBy("component").agg(F.min("_first").alias("class_id"))
    return keep(firsts.join(smallest, "component").select("content", "class_id", "_n"), "classes")


def one_of_each(docs: DataFrame, similarity: float = 0.8, max_bits: int | None = None) -> DataFrame:
    """Documents without those of verified likeness, over any chain of links, to a document of smaller id; ASCII letters in lower
    case. Of rows that share the smallest id all stay; null ids stay only where their whole class has none."""
    found = near_duplicates(docs, similarity, True, max_bits)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
