import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from curatorium.llm import warc

TRICKY = "a\r\n\r\nWARC/1.1\r\nb"


def run(spark, rows, tmp_path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(1), "sha": F.lit("x")})
    folder = f"file://{tmp_path}/warc"
    warc.write(pages, folder, **options)
    return warc.captures(warc.read(spark, folder)).collect()


def test_round_trip_and_revisits(spark, tmp_path):
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "http://x/\r\nEvil: 1", TRICKY * 2),
            (6, "v", "é" * 100_000 + TRICKY + "\r\n\r\n"), (7, "w", "\r\n\r\n"), (8, "z", "WARC/1.1\r\nx\r\n"), (None, "n", "same"), (11, "q", TRICKY + TRICKY[1:])]
    got = run(spark, rows, tmp_path)
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    by_id = {r["metadata"]["page_id"]: r for r in got}
    for i, url, html in rows:
        r, payload = by_id["null" if i is None else str(i)], (html or "").encode()
        x = r["response"]
        assert x["payload_bytes"] == len(payload)
        assert x["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert x["type"] == ("response" if first[html or ""] == i else "revisit")
        assert r["request"]["target"] == x["target"] == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))
        if x["type"] == "response":
            assert bytes(x["payload"]) == payload and x["digest_holds"] and r["refers_to"] is None
        else:
            assert x["payload"] is None and r["refers_to"]["page_id"] == str(first[html or ""])


def test_small_payloads_are_always_responses(spark, tmp_path):
    got = run(spark, [(1, "a", "xx"), (2, "a", "xx"), (3, "a", "xxx"), (4, "a", "xxx")], tmp_path, min_bytes=3)
    assert sorted((r["metadata"]["page_id"], r["response"]["type"]) for r in got) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_repeated_rows_are_captures_of_their_own(spark, tmp_path):
    got = run(spark, [(1, "a", "x")] * 4 + [(1, "b", "x")], tmp_path)
    assert len(got) == 5 and sorted(r["response"]["type"] for r in got) == ["response"] + ["revisit"] * 4
    assert len({r["capture_id"] for r in got}) == 5 and all(r["refers_to"]["page_id"] == "1" for r in got if r["refers_to"])


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_transactions_from_records(spark):
    """Records without partners, repeated records and a revisit whose response is missing."""
    kind = ("type string, record_id string, concurrent_to string, refers_to string, target string, payload_digest string, payload_bytes long, "
            "page_id string, payload binary, digest_holds boolean")
    rows = [("response", "r1", None, None, "t", "d", 1, None, b"x", True), ("response", "r1", None, None, "t", "d", 1, None, b"x", True),
            ("revisit", "r2", None, "gone", "t", "d", 1, None, None, None), ("request", "q1", "r1", None, "t", None, None, None, None, None),
            ("metadata", "m1", "nobody", None, None, None, None, "7", None, None), ("request", "q2", None, None, None, None, None, None, None, None),
            ("warcinfo", "w", None, None, None, None, None, None, None, None)]
    got = {r["capture_id"]: r for r in warc.captures(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"]["request"]["record_id"] == "q1" and got["r1"]["metadata"] is None
    assert got["r2"]["request"] is None and got["r2"]["refers_to"] is None


def test_a_cut_record_is_an_error():
    with pytest.raises(ValueError):
        warc.parse(b"WARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 10\r\n\r\nshort")
