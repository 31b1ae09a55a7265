import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from curatorium.llm import bpe
from curatorium.llm.queries import rank_file

PATH, PATTERN = rank_file()
TEXTS = ["", None, "a", "Hello  world\n\n\tx 's don't 12345 ünïcödé 日本語 🙂", " " * 3000, "\n" * 2000 + "x", "word " * 9000,
         "x" * 5000, "<|endoftext|> literal", "a  b   c    d", "tab\t\tend ", "'s's 'll", "   nb"]


def plain(text):
    return bpe.encoding(PATH, PATTERN).encode_ordinary(text or "")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_pieces_give_the_ids_of_one_pass(size):
    tokens = bpe.encoding(PATH, PATTERN)
    for t in TEXTS:
        assert "".join(bpe.pieces(t or "", size)) == (t or "")
        assert bpe.encode(tokens, t or "", size) == plain(t)


def test_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, None), (None, "a")], "doc_id long, text string")
    docs = docs.withColumns({"ids": F.lit("old"), "n_tokens": F.lit("old"), "odd name": F.lit(1)})
    got = bpe.encoded(docs, PATH, PATTERN, digests=True)
    assert got.columns[:3] == ["doc_id", "text", "odd name"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = plain(r["text"])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decoded(got, PATH, PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)


def test_raw_bytes_that_are_no_text(spark):
    ids = [i for i in range(256) if bpe.encoding(PATH, PATTERN).decode_bytes([i])]
    rows = spark.createDataFrame([(ids,), (None,), ([],)], "ids array<int>")
    got = [r["decoded"] for r in bpe.decoded(rows, PATH, PATTERN).collect()]
    assert sorted(bytes(got[0])) == list(range(256)) and got[1] is None and bytes(got[2]) == b""


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_path_is_that_of_the_installed_file():
    assert PATH == public_tokenizers.path("byte_bpe_50k.tiktoken")
