"""Order-dependent operators that hold when one key owns a third of all rows.

A plain window sends a whole key to one task. Three replacements are used instead:

* `first_k`: only the first k rows of a key are wanted and k is bounded, so every map task keeps
  k rows per key before the shuffle (the planner's window group limit).
* `running`: positions and running sums/maxima over the full order. Rows are range-partitioned on
  (key, order), which splits a hot key over many segments; each segment is windowed on its own and
  the few keys that cross a segment border get a carried-in value from a table with at most two
  rows per segment.
* `compose`: a state machine of which only few start states can act differently. A first pass works out, per
  segment, the end state for each of them; composed over the borders they give every segment's start
  state, with which a second pass answers all rows. Two passes, however many segments a key fills.
* `fold`: any sequential state machine. Segments run in parallel from a guessed start
  state; those whose start state turns out different run again until nothing changes. Since a
  segment only depends on earlier ones, the fixpoint is exactly the sequential result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from curatorium.session import cut_lineage

SEGMENT = "_segment"
ROW = "_row"
# the planner limits groups before the shuffle up to this k (spark.sql.optimizer.windowGroupLimitThreshold)
GROUP_LIMIT = 1000
DEAL, DEALS = "_deal", 64


def first_k(df: DataFrame, keys: list[str], order: list[str | Column], k: int, name: str = "position") -> DataFrame:
    """The first k rows of every key with their position, 1..k.

    The planner cuts a key to k rows before the shuffle only up to GROUP_LIMIT; beyond it rows are dealt out by a hash first,
    so that a key's rows are cut in many tasks and k from each of them meet."""
    window = Window.partitionBy(*keys).orderBy(*order)
    if k > GROUP_LIMIT:
        dealt = df.withColumn(DEAL, F.pmod(F.xxhash64(*df.columns), F.lit(DEALS)))
        part = Window.partitionBy(*keys, DEAL).orderBy(*order)
        df = dealt.withColumn(name, F.row_number().over(part)).where(F.col(name) <= k).select(*df.columns)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def segments(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Sorted by (keys, order) and cut into even segments; kept, so every later pass sees the same cuts."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    row_in_partition = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return cut_lineage(
        df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
        .withColumns({SEGMENT: F.spark_partition_id(), ROW: row_in_partition})
    )


def _edge_rows(laid: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the first and last row of every segment; one or two small rows per segment."""
    sizes = laid.groupBy(SEGMENT).agg(F.max(ROW).alias("_last"))
    edge = (F.col(ROW) == 0) | (F.col(ROW) == F.col("_last"))
    return laid.join(F.broadcast(sizes), SEGMENT).where(edge).select(SEGMENT, ROW, *keys)


def _edges(rows: DataFrame, keys: list[str]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in rows.orderBy(SEGMENT, ROW).collect():
        out.setdefault(r[SEGMENT], []).append(tuple(r[k] for k in keys))
    return out


def _crossing(edges: dict[int, list[tuple]]) -> set[int]:
    """Edge rows of keys that continue over a segment border, by twice the segment, one more if not its first row."""
    out = set()
    order = sorted(edges)
    for left, right in zip(order, order[1:]):
        if edges[left][-1] == edges[right][0]:
            out |= {2 * left + len(edges[left]) - 1, 2 * right}
    return out


def running(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, Column | None]], parts: int | None = None
) -> DataFrame:
    """Add running values up to and including each row; kinds are 'count', 'sum' and 'max'."""
    laid = segments(df, keys, order, parts)
    here = Window.partitionBy(SEGMENT, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    local, totals, carried = {}, [], []
    for name, (kind, value) in columns.items():
        if kind == "count":
            # without a key the row's place in its sorted segment is the position already
            local[name] = (F.row_number().over(Window.partitionBy(SEGMENT, *keys).orderBy(*order)) if keys
                           else F.col(ROW) + 1)
            totals.append(F.count(F.lit(1)).alias(name))
        else:
            combine = F.sum if kind == "sum" else F.max
            local[name] = combine(value).over(here)
            totals.append(combine(value).alias(name))
        carried.append((F.max if kind == "max" else F.sum)(name).over(earlier).alias("_c_" + name))
    out = laid.withColumns(local)
    edges = cut_lineage(_edge_rows(laid, keys))
    wanted = _crossing(_edges(edges, keys))
    if wanted:
        # both small sides have at most two rows per segment, so the partition count bounds the broadcast
        small = ["_k_" + c for c in (SEGMENT, *keys)]
        # chosen from the edge rows, as rows made on the driver would start Python workers in the executors
        crossing = edges.where((2 * F.col(SEGMENT) + (F.col(ROW) > 0).cast("int")).isin(wanted)).select(SEGMENT, *keys).toDF(*small)
        # null-safe, since a missing key is a group of its own
        same = [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in (SEGMENT, *keys)]
        summary = laid.join(F.broadcast(crossing), same, "left_semi").groupBy(SEGMENT, *keys).agg(*totals)
        carry = cut_lineage(summary.select(SEGMENT, *keys, *carried)).withColumnsRenamed(dict(zip((SEGMENT, *keys), small)))
        out = out.join(F.broadcast(carry), same, "left").drop(*small)
        for name, (kind, _) in columns.items():
            before = F.col("_c_" + name)
            if kind == "max":
                value = F.greatest(F.col(name), before)
            else:
                value = F.when(F.col(name).isNotNull() | before.isNotNull(),
                               F.coalesce(F.col(name), F.lit(0)) + F.coalesce(before, F.lit(0)))
            out = out.withColumn(name, value)
    return out.drop(SEGMENT, ROW, *["_c_" + name for name in columns])


def position(df: DataFrame, keys: list[str], order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    return running(df, keys, order, {name: ("count", None)}, parts)


Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


def fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    inputs: dict[str, Column],
    start: tuple,
    step: Step,
    outputs: str,
    parts: int | None = None,
) -> DataFrame:
    """Replay each key's rows in order: step(state, inputs) -> (state, outputs).

    The state is a small flat tuple of numbers and strings; keys must not be null. Only the states at segment borders
    pass through the driver, one per segment. Returns keys, order and the output columns.
    """
    given = {"_in_" + name: value for name, value in inputs.items()}
    laid = segments(df.select(*keys, *order, *[c.alias(n) for n, c in given.items()]), keys, order, parts)
    columns = [SEGMENT, *keys, *order, *given]
    width, key_count = len(columns) - len(given), len(keys)
    names = [*keys, *order, *[part.split()[0] for part in outputs.split(",")]]
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in laid.select(*keys, *order).schema.fields]

    def replay(frames: Iterator[pd.DataFrame], carries: dict) -> Iterator[tuple]:
        """Yields (segment, row without inputs, outputs, state after the row)."""
        key, segment, state = None, None, start
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                row_key = row[1 : 1 + key_count]
                if row[0] != segment:
                    state = carries.get(row[0], start)
                elif row_key != key:
                    state = start
                segment, key = row[0], row_key
                state, values = step(state, row[width:])
                yield segment, row[1:width], values, state

    def emit(frames: Iterator[pd.DataFrame], carries: dict) -> Iterator[pd.DataFrame]:
        rows = (row + values for _, row, values, _ in replay(frames, carries))
        while batch := list(islice(rows, 20_000)):
            yield pd.DataFrame(batch, columns=names)

    def last_state(frames: Iterator[pd.DataFrame], carries: dict) -> Iterator[pd.DataFrame]:
        last = None
        for last in replay(frames, carries):
            pass
        if last is not None:
            yield pd.DataFrame([(last[0], json.dumps(last[3]))], columns=["segment", "state"])

    # which key runs over a border, and into which segment
    edges = _edges(_edge_rows(laid, keys), keys)
    order_of = sorted(edges)
    into = {b: a for a, b in zip(order_of, order_of[1:]) if edges[a][-1] == edges[b][0]}
    whole = {s for s in order_of if edges[s][0] == edges[s][-1]}
    sources = set(into.values())

    carries: dict[int, tuple] = {}
    pending = sources
    while pending:
        # only the last key of a segment flows on, so only its rows are replayed here
        wanted = laid.sparkSession.createDataFrame(
            [(s, *edges[s][-1]) for s in sorted(pending)], laid.select(SEGMENT, *keys).schema)
        tails = laid.select(*columns).join(F.broadcast(wanted), [SEGMENT, *keys], "left_semi")
        # a start state from before reaches the last key only where it fills the whole segment
        usable = {s: c for s, c in carries.items() if s in whole}
        ends = tails.mapInPandas(partial(last_state, carries=usable), "segment int, state string").collect()
        state_of = {r["segment"]: tuple(json.loads(r["state"])) for r in ends}
        changed = {s for s, a in into.items() if a in state_of and carries.get(s, start) != state_of[a]}
        carries.update({s: state_of[into[s]] for s in changed})
        pending = changed & whole & sources
    return laid.select(*columns).mapInPandas(partial(emit, carries=carries), ", ".join([*kept, outputs]))


class Automaton:
    """A machine for `compose`. States are flat tuples of numbers; `entries` has one row for every group of start states that
    act alike on a segment which begins with the given row."""

    start: tuple = ()

    def entries(self, row: tuple) -> np.ndarray:
        raise NotImplementedError

    def advance(self, states: np.ndarray, row: tuple) -> np.ndarray:
        """`step` for many states at once."""
        raise NotImplementedError

    def leave(self, entries: np.ndarray, ends: np.ndarray, state: tuple, rows: int) -> tuple:
        """The state after a segment of so many rows that was entered with `state`."""
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError


MERGE_EVERY = 16  # rows between looks for start states that have become one


def compose(df: DataFrame, keys: list[str], order: list[str], inputs: dict[str, Column], machine: Automaton, outputs: str,
            parts: int | None = None) -> DataFrame:
    """Replay each key's rows in order through `machine`; returns keys, order and the output columns.

    The first pass reads a segment once. While its rows have one key, all entries advance together, as arrays, and those that
    reach the same state go on as one. What reaches the driver is a row per segment: its end state, or for a
    segment that one key fills, the end state of each entry. Keys must not be null."""
    given = {"_in_" + name: value for name, value in inputs.items()}
    laid = segments(df.select(*keys, *order, *[c.alias(n) for n, c in given.items()]), keys, order, parts)
    columns = [SEGMENT, *keys, *order, *given]
    first_key, first_input = 1, 1 + len(keys) + len(order)
    fields = {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    names = [*keys, *order, *[part.split()[0] for part in outputs.split(",")]]

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            yield from zip(*[frame[c].tolist() for c in columns])

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = key = segment = state = None
        entries = states = inverse = None
        n, whole = 0, True
        for row in rows_of(frames):
            segment, own, values = row[0], row[first_key : first_key + len(keys)], row[first_input:]
            if begin is None:
                begin = key = own
                entries = np.asarray(machine.entries(values), float)
                states, inverse = entries, np.arange(len(entries))
                state = machine.start
            if own != key:
                key, whole, state = own, False, machine.start
            if whole:
                states = machine.advance(states, values)
                if n % MERGE_EVERY == 0 and len(states) > 1:
                    states, back = np.unique(states, axis=0, return_inverse=True)
                    inverse = back.reshape(-1)[inverse]
                n += 1
            else:
                state, _ = machine.step(state, values)
        if begin is not None:
            ends = states[inverse] if whole else np.array([state], float)
            yield pd.DataFrame([(segment, *begin, *key, whole, n, entries.tobytes() if whole else b"", ends.tobytes(), ends.shape[1])], columns=table_names)

    table_names = ["segment", *[f"_a{i}" for i in range(len(keys))], *[f"_b{i}" for i in range(len(keys))], "whole", "n", "entries", "ends", "width"]
    kinds = [fields[k] for k in keys]
    schema = ", ".join(f"{n} {k}" for n, k in zip(table_names, ["int", *kinds, *kinds, "boolean", "long", "binary", "binary", "int"]))
    found = sorted(laid.select(*columns).mapInPandas(tables, schema).collect(), key=lambda r: r["segment"])
    carries: dict[int, tuple] = {}
    last, state = None, None
    for r in found:
        begin, end = (tuple(r[f"_{side}{i}"] for i in range(len(keys))) for side in "ab")
        if begin == last:
            carries[r["segment"]] = state
        ends = np.frombuffer(r["ends"], float).reshape(-1, r["width"])
        if r["whole"]:
            entries = np.frombuffer(r["entries"], float).reshape(-1, r["width"])
            state = machine.leave(entries, ends, carries.get(r["segment"], machine.start), r["n"])
        else:
            state = tuple(ends[0].tolist())
        last = end

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for row in rows_of(frames):
            own = row[first_key : first_key + len(keys)]
            if key is None:
                state = carries.get(row[0], machine.start)
            elif own != key:
                state = machine.start
            key = own
            state, values = machine.step(state, row[first_input:])
            out.append(row[1:first_input] + values)
            if len(out) == 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    kept = [f"{c} {fields[c]}" for c in (*keys, *order)]
    return laid.select(*columns).mapInPandas(emit, ", ".join([*kept, outputs]))
