"""Mixing sources to target weights by weighted fair queueing.

A document's size is its number of words (runs without ASCII white space; null: 0). Sources in order of their code points,
null last, weigh 5, 2, 1, repeating, and share the whole size of all documents by weight; a target stops at `most` times
its source's size, and the excess is shared again among the others, until none is above.

Each source deals its documents in the order of a hash, pass after pass, `most` passes in all. A copy's virtual finish time is
the number of its source's words dealt up to its middle word, divided by the source's target; with the middle rather than the end,
sources end above their targets as often as below, by half a document at most. All copies are range-sorted by finish time,
and the mix takes them from the start until the next one would exceed the total. Ties go by source, hash and id, so reruns agree;
rows equal in id, source and size are one ticket of their whole size, taken or left together. Documents without words are taken 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatorium.llm.store import keep, packed, parts_for, unpacked
from curatorium.operators.ordered import position, running

WEIGHTS, MOST = (5, 2, 1), 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")) - F.when(
        F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) == "", 1).otherwise(0), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> those and target. One row per source; only sums reach the driver, once per round."""
    placed = position(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_place")
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = keep(placed.select("source", "source_size", chosen.cast("long").alias("weight"),
                              (F.col("source_size") * most).alias("cap")), "source-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    full, before = F.lit(False), None
    while True:
        # words left and weight for the sources that aren't full; a share only grows, so a full source stays full
        sums = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        left, weight = total - (sums[0] or 0), sums[1] or 0
        if sums[2] == before or not weight:
            break
        before = sums[2]
        share = F.col("weight") * (F.lit(float(left)) / F.lit(float(weight)))
        full = share >= F.col("cap")
    target = F.when(full, F.col("cap").cast("double")).otherwise(share) if before is not None else F.col("cap").cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def tickets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, text: str = "text") -> DataFrame:
    """`mixed` with one row for equal rows, and their number in `times`."""
    rows = docs.select("doc_id", "source", word_count(F.col(text)).alias("size"))
    sizes = keep(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    whole = F.col("size") * F.col("times")
    goal = keep(targets(sizes.groupBy("source").agg(F.sum(whole).alias("source_size")), weights, most), "targets")
    # the first 60 bits of the hash, as a number: what the range partitioner samples stays small
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = sizes.withColumn("deal", F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"))
    parts = parts_for(sizes, sizes.count())
    # a source of any size is cut into ranges of its order
    summed = running(dealt, ["source"], ["deal", "doc_id", "size"], {"upto": ("sum", whole)}, parts)
    joined = summed.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    queue = keep(joined, "queue")
    nth = [F.when(F.col("target") > 0, (2 * F.col("upto") - whole + 2 * k * F.col("source_size")) / (2 * F.col("target"))) for k in range(most)]
    tie = [F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("deal"), F.coalesce("doc_id", F.lit(-1 << 63))]
    names = ["finish", "t1", "t2", "t3", "t4"]

    def ticket(finish: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip([finish, *tie], names)])

    copies = queue.where("size > 0").select(whole.alias("size"), F.explode(F.array(*[ticket(n) for n in nth])).alias("t")).select("size", "t.*")
    lined = running(copies, [], names, {"all": ("sum", F.col("size"))}, parts * most)
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    last = lined.where(F.col("all") <= total).agg(F.max(F.struct(*names)).alias("t")).first()["t"]
    if last is None:
        taken = F.lit(0)
    else:
        end = F.struct(*[F.lit(last[n]).cast(k).alias(n) for n, k in zip(names, ("double", "boolean", "string", "bigint", "bigint"))])
        taken = sum((F.when(ticket(n) <= end, 1).otherwise(0) for n in nth), F.lit(0))
    return queue.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "times")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row; other columns are not read."""
    return tickets(docs, **options).withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, none that isn't."""
    found = tickets(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    row = packed(docs).withColumn("_own", word_count(F.col("_row.text")))
    joined = row.join(found, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source"))
                      & (F.col("_own") == F.col("_size")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*unpacked(docs))
