"""WARC archives: writing captures, reading records, assembling transactions.

Each page gives three records: request, response (or revisit) and metadata. The metadata and the request name the response in
WARC-Concurrent-To. Of the pages with equal payloads (length and SHA-1) of at least `min_bytes`, the one with the smallest page_id
is a response; the others are revisits without payload that name it in WARC-Refers-To. Null html is the empty payload, a
null URL leaves out the target. Rows that repeat page_id, URL and payload are captures of their own, numbered; only the first of
them can be the response. Null page_ids come last among equal payloads.

Archives are Spark text output whose line separator is the blank line that ends a record, in gzip files, so tasks can be repeated
and any file system serves. They are read record by record, at the next record's version line; a payload that holds
such a line is sent chunked, cut inside it. A record that was split anyway, in an archive from elsewhere, is an error, not a loss.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from curatorium.llm.store import keep

_VERSION, _END = "WARC/1.1\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_ID_HEADER = "WARC-Record-ID"


def _digest(payload: Column) -> tuple[Column, Column]:
    return F.sha1(payload), F.octet_length(payload).cast("long")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _base32(hexes: Column) -> Column:
    """Base32 of 20 bytes given as hex: five hex digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(i: int) -> Column:
        n = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        return F.concat(*[F.substr(F.lit(letters), F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)])

    return F.concat(*[four(i) for i in range(8)])


def _one_line(value: Column) -> Column:
    """A header value: control characters and blanks percent-encoded."""
    out = value
    for code in (9, 10, 13, 32):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The distinct (page_id, url, sha, length) and `first`, the page_id whose payload stands for equal ones. No payload moves."""
    sha, length = _digest(F.coalesce("html", F.lit("")))
    own = pages.select("page_id", "url", sha.alias("sha"), length.alias("length")).distinct()
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("u"), "url")
    first = own.where(F.col("length") >= min_bytes).groupBy("sha", "length").agg(F.min(order).alias("_first"))
    return own.join(first, ["sha", "length"], "left").withColumn(
        "is_first", F.col("_first").isNull() | F.col("_first").eqNullSafe(order)).withColumns(
        {"first": F.col("_first.page_id"), "first_url": F.col("_first.url")}).drop("_first")


def _head(kind: str, record_id: Column, more: list[Column], content: str, block: Column) -> Column:
    line = [F.lit(f"{_VERSION}WARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n{_ID_HEADER}: "), record_id, F.lit("\r\n"), *more,
            F.lit(f"Content-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block]
    return F.concat(*line)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _chunked(payload: Column) -> Column:
    """The payload in HTTP chunks, none of which holds a whole version line."""
    parts = F.split(payload, F.lit("\\Q" + _VERSION + "\\E"))
    whole = F.transform(parts, lambda p, i: F.concat(
        F.when(i > 0, _VERSION[4:]).otherwise(""), p, F.when(i < F.size(parts) - 1, _VERSION[:4]).otherwise("")))
    chunks = F.filter(whole, lambda p: p != "")
    return F.concat(F.array_join(F.transform(chunks, lambda p: F.concat(
        F.lower(F.hex(F.octet_length(p))), F.lit("\r\n"), p, F.lit("\r\n"))), ""), F.lit("0\r\n\r\n"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_rows: int = 3000) -> None:
    """Three records per row of pages (page_id, url, html), in gzip archives of at most `file_rows` captures."""
    sha, length = _digest(F.coalesce("html", F.lit("")))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"sha": sha, "length": length})
    # one key for join and numbering, so the payloads are shuffled once
    key = F.md5(F.to_json(F.struct("page_id", "url", "sha", "length")))
    given = roles(pages, min_bytes).select(key.alias("_key"), "is_first", "first", "first_url")
    rows = own.withColumn("_key", key).join(given, "_key").withColumn(
        "copy", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = rows.withColumns({
        "revisit": ~(F.col("is_first") & ((F.col("copy") == 1) | (F.col("length") < min_bytes))),
        "target": _header("WARC-Target-URI", _one_line(F.col("url"))),
        "digest": F.concat(F.lit("WARC-Payload-Digest: sha1:"), _base32(F.col("sha")), F.lit("\r\n")),
        "nested": F.contains("html", F.lit(_VERSION)),
    })
    ids = {n: _uuid(F.lit(n), text("page_id"), text("url"), F.col("sha"), F.col("copy").cast("string"))
           for n in ("request", "response", "metadata")}
    rows = rows.withColumns({n + "_id": c for n, c in ids.items()}).withColumn(
        "refers", _uuid(F.lit("response"), text("first"), text("first_url"), F.col("sha"), F.lit("1")))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.when(
        F.col("nested") & ~F.col("revisit"), "Transfer-Encoding: chunked").otherwise(
        F.concat(F.lit("Content-Length: "), F.col("length").cast("string"))), F.lit(_END))
    rows = rows.withColumns({
        "answer": F.when(F.col("revisit"), status).when(F.col("nested"), F.concat(status, _chunked(F.col("html")))).otherwise(
            F.concat(status, F.col("html"))),
        "ask": F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.coalesce(_one_line(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit("")), F.lit(_END)),
        "about": F.concat(F.lit("page-id: "), text("page_id"), F.lit("\r\n")),
    })
    to = _header("WARC-Concurrent-To", F.col("response_id"))
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    target, digest = F.col("target"), F.col("digest")
    answer = F.when(F.col("revisit"), _head("revisit", F.col("response_id"), [
        target, digest, F.lit(profile), _header("WARC-Refers-To", F.col("refers"))], "application/http; msgtype=response", F.col("answer"))
    ).otherwise(_head("response", F.col("response_id"), [target, digest], "application/http; msgtype=response", F.col("answer")))
    records = rows.select(F.explode(F.array(
        _head("request", F.col("request_id"), [target, to], "application/http; msgtype=request", F.col("ask")), answer,
        _head("metadata", F.col("metadata_id"), [target, to], "application/warc-fields", F.col("about")))).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 3 * file_rows).text(folder)


_FLAT = ("type string, record_id string, concurrent_to string, refers_to string, target string, payload_digest string, "
         "payload_bytes long, page_id string, payload binary, digest_holds boolean")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def parse(record: bytes) -> dict:
    """Fields of one record without its version line; it may end with the blank line that separates records."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in head.decode("utf-8", "replace").split("\r\n"))}
    size = int(headers.get("content-length", -1))
    if size < 0 or "warc-record-id" not in headers or len(rest) < size or rest[size:].strip(b"\r\n"):
        raise ValueError(f"not a whole WARC record: {head[:200]!r}")
    block, kind = rest[:size], headers.get("warc-type")
    out = {"type": kind, "record_id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"),
           "refers_to": headers.get("warc-refers-to"), "target": headers.get("warc-target-uri"),
           "payload_digest": (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
           "payload_bytes": None, "page_id": None, "payload": None, "digest_holds": None}
    if kind in ("response", "revisit"):
        lines, _, body = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (h.partition(b":") for h in lines.split(b"\r\n"))}
        if kind == "response":
            payload = _unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out |= {"payload": payload, "payload_bytes": len(payload), "digest_holds": own == (out["payload_digest"] or own),
                    "payload_digest": own}
        elif b"content-length" in http:
            out["payload_bytes"] = int(http[b"content-length"])
    elif kind == "metadata":
        fields = dict(line.split(b": ", 1) for line in block.split(b"\r\n") if b": " in line)
        out["page_id"] = fields.get(b"page-id", b"").decode() or None
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from curatorium.llm.bpe import slices

        schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
                            ("target", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.string()),
                            ("payload", pa.binary()), ("digest_holds", pa.bool_())])
        for whole in batches:
            for part in slices(whole, "value"):
                yield pa.RecordBatch.from_pylist([parse(r) for r in part.column(0).to_pylist()], schema)

    # a separator whose first byte it holds only once: readers may miss one that overlaps itself at the end of a buffer
    records = spark.read.option("lineSep", _VERSION).text(folder).where("value <> ''").select(F.col("value").cast("binary").alias("value"))
    return records.mapInArrow(run, _FLAT)


def captures(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per response or revisit: response, and request and metadata where records name it (null else), and the
    response that a revisit refers to. Records that repeat an id count once. They are parsed once and kept, without payloads if those
    aren't wanted."""
    records = keep(records if payload else records.drop("payload"), "records")
    main = records.where("type in ('response', 'revisit')").dropDuplicates(["record_id"])
    out = main.select(F.col("record_id").alias("capture_id"), F.struct(
        "type", "record_id", "target", "refers_to", "payload_digest", "payload_bytes", "digest_holds", *(["payload"] if payload else [])).alias("response"))
    for kind, fields in (("request", ["record_id", "target"]), ("metadata", ["record_id", "page_id"])):
        side = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy("concurrent_to").agg(
            F.min(F.struct(*fields)).alias(kind))
        out = out.join(side.withColumnRenamed("concurrent_to", "capture_id"), "capture_id", "left")
    found = out.select(F.col("capture_id").alias("_seen"), F.struct(
        F.col("capture_id").alias("record_id"), F.col("metadata.page_id").alias("page_id")).alias("refers_to")).where("_seen is not null")
    # responses that very many revisits refer to, 200 at most, are broadcast; and rows that refer to nothing (or to those) are
    # dealt out by a name nobody else has instead of meeting under one missing key
    many = main.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("_n"))
    frequent = many.where(F.col("_n") * 200 > main.count()).select(F.col("refers_to").alias("_seen"))
    hot = F.broadcast(keep(found.join(F.broadcast(frequent), "_seen"), "frequent-responses").toDF("_often", "_at_once"))
    out = out.join(hot, F.col("response.refers_to") == F.col("_often"), "left")
    own = F.when(F.col("_often").isNull(), F.col("response.refers_to"))
    joined = out.withColumn("_key", F.coalesce(own, F.concat(F.lit("-"), "capture_id"))).join(found, F.col("_key") == F.col("_seen"), "left")
    return joined.withColumn("refers_to", F.coalesce("_at_once", "refers_to")).drop("_often", "_at_once", "_key", "_seen")
