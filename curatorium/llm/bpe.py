"""Byte-level BPE encoding and decoding with a local rank file.

The rank file's path and the split pattern are parameters; each Python worker loads the file once. Texts are encoded whole: long
ones are cut before white space, where the pattern of `public_tokenizers` can never match across, so ids equal those of one
pass. Another pattern must have that property too, or LONG must be raised. Null is the empty text: no ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

LONG = 50_000  # characters; longer texts are cut
# a cut lies between a character and white space: letters, digits and signs end there, and white space looks only ahead
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_BLANK = regex.compile(r"\s+")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _decimals(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(path, pattern).max_token_value + 1)]


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of at least `size` characters, but for the last, that may be encoded one by one."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(tokens: tiktoken.Encoding, text: str, size: int = LONG) -> list[int]:
    if len(text) <= size:
        return tokens.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in tokens.encode_ordinary(part)]


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """All columns of `docs` and n_tokens; with `ids` the ids and whether their decoded bytes are the text's; with `digests` the
    SHA-256 of the ids in decimal, joined by one space, and of the decoded bytes. Columns of those names are replaced."""
    added = {"n_tokens": LongType()}
    if ids:
        added |= {"ids": ArrayType(IntegerType()), "round_trip": BooleanType()}
    if digests:
        added |= {"ids_sha256": StringType(), "decoded_sha256": StringType()}
    docs = docs.drop(*added)
    schema = StructType([*docs.schema.fields, *[StructField(name, kind) for name, kind in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, decimal = encoding(path, pattern), _decimals(path, pattern)
        for whole in batches:
            for part in slices(whole, text):
                rows: dict[str, list] = {name: [] for name in added}
                for value in part.column(text).to_pylist():
                    found = encode(tokens, value or "")
                    rows["n_tokens"].append(len(found))
                    back = tokens.decode_bytes(found)
                    if ids:
                        rows["ids"].append(np.array(found, np.int32))
                        rows["round_trip"].append(back == (value or "").encode())
                    if digests:
                        rows["ids_sha256"].append(hashlib.sha256(" ".join([decimal[i] for i in found]).encode()).hexdigest())
                        rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "round_trip": pa.bool_()}
                arrays = [pa.array(v, kinds.get(name, pa.string())) for name, v in rows.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, one row at least, so that work per part stays small."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the raw bytes that the ids stand for; null ids give null. An id outside the ranks is an error."""

    @F.pandas_udf("binary")
    def run(values):
        tokens = encoding(path, pattern)
        return values.map(lambda v: None if v is None else tokens.decode_bytes([int(i) for i in v]))

    return rows.withColumn(out, run(F.col(ids)))
