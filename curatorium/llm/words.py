"""Vectorised words and shingles of Arrow string columns.

A word is a run of bytes other than ASCII white space. Whole columns are handled as one byte buffer; work arrays
cover a few megabytes at a time, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[str, np.ndarray] = {}


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts.astype(np.int64) - starts[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; the longest tables so far are kept."""
    if len(_tables.get("up", ())) <= n:
        size = 1 << max(int(n).bit_length(), CHUNK.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size + 1, base, np.uint64)
            factors[0] = 1
            _tables[name] = np.cumprod(factors)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end between words."""
    at, n = 0, len(data)
    while at < n:
        end = at + CHUNK
        if end >= n:
            yield at, n
            return
        border = int(starts[np.searchsorted(starts, end)])  # the next text's begin
        while end < border:
            blank = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            if len(blank):
                border = min(border, end + int(blank[0]))
                break
            end += CHUNK
        yield at, border
        at = border


def spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; texts are not run together."""
    dark = ~_SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[starts] = True
    before = np.concatenate([[False], dark[:-1]]) & ~new[:-1]
    after = np.concatenate([dark[1:], [False]]) & ~new[1:]
    return np.flatnonzero(dark & ~before), np.flatnonzero(dark & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each text's words begin (one more than texts)."""
    hashes, begins = [], []
    for a, b in _cuts(data, starts):
        part = data[a:b]
        inner = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b, "right")] - a
        begin, end = spans(part, inner)
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[end] - sums[begin]) * down[begin]))
        begins.append(begin + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), starts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and where each text's begin. A shorter text is one run; one without words none."""
    counts = np.diff(first)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    runs = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(out[-1]) - out[text] + first[text]
    short = counts[text] < size
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        value = padded[at + j]
        if short.any():
            value = np.where(short & (j >= counts[text]), np.uint64(0), value)
        total = total * np.uint64(_BASE) + value
    return mix(total), out


def parts(column: pa.Array, size: int = CHUNK) -> Iterator[pa.Array]:
    """A column of texts in slices of about `size` bytes, one text at least, so that copies of a batch are never made whole."""
    for a, b in blocks(raw(column)[1], size):
        yield column.slice(a, b - a)


def blocks(starts: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` bytes together, one text at least."""
    at, n = 0, len(starts) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = end
