"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is written as three records, request, response (or revisit) and metadata; request and metadata name the
response in WARC-Concurrent-To. A WARC record ends with two line ends, so Spark's text writer with that line separator
writes archives byte for byte, gzipped by its codec. Archives are read whole, file by file, and cut by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baleprice.llm.common import written

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 5 hexadecimal digits are 20 bits, 4 base32 digits."""
    digest = F.sha1(payload)
    digits = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(d, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                      for d in digits for j in range(4)])


def _lines(*fields) -> Column:
    """Header lines; a pair whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit("")) for name, value in fields])


def _record(kind: Column, record: Column, uri: Column, block: Column, mime: str, *more) -> Column:
    """A record without its two closing line ends."""
    return F.concat(F.lit("WARC/1.1" + _END), _lines(
        ("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<"), record, F.lit(">"))), ("WARC-Date", F.lit(_DATE)),
        ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(mime)),
        ("Content-Length", F.octet_length(block).cast("string"))), F.lit(_END), block)


def _urn(kind: str, capture: str) -> Column:
    """A record's name: a hash of its kind and capture, shaped as a UUID."""
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit(kind + " "), F.col(capture)).cast("binary")),
                                                       "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def write_captures(captures: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Archives of ``captures`` (page_id, url, html) in ``path``: three records each.

    Of captures with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest page_id is the
    response, the others are revisits of it without a payload; smaller payloads are always responses. A null html is
    an empty payload; null urls give no target; a null page_id sorts before all others. Rows with equal page_id, url
    and payload are told apart by a number, the last is the response. Other columns are ignored; no rows, no
    records. A payload is shuffled once, however many captures share it."""
    pages = captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\r\n]", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    pages = pages.withColumn("size", F.octet_length("html").cast("long")).withColumn("_row", F.concat_ws(
        " ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.concat(F.lit("="), "url"), "digest"))
    heads = written(pages.groupBy("_row", "digest", "size", "page_id", "url").agg(F.count("*").alias("copies")), "captures")
    best = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url", "copies", "_row")).alias("best"))
    numbered = heads.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).join(best, "digest")
    numbered = numbered.withColumn("_capture", F.concat_ws(" ", "_row", "nth")).withColumn(
        "_first", F.concat_ws(" ", "best._row", "best.copies")).withColumn(
        "_revisit", (F.col("size") >= min_revisit_bytes) & (F.col("_capture") != F.col("_first")))
    response, target = _urn("response", "_capture"), F.col("url")
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    status = F.lit("HTTP/1.1 200 OK" + _END + "Content-Type: text/html; charset=utf-8" + _END + _END)
    request = _record(F.lit("request"), _urn("request", "_capture"), target, F.concat(
        F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1" + _END + _END)),
        "application/http;msgtype=request", ("WARC-Concurrent-To", angle(response)))
    metadata = _record(F.lit("metadata"), _urn("metadata", "_capture"), target, F.concat(
        F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_END)),
        "application/warc-fields", ("WARC-Concurrent-To", angle(response)))
    revisit = _record(F.lit("revisit"), response, target, status, "application/http;msgtype=response", digest,
                      ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                      ("WARC-Refers-To", angle(_urn("response", "_first"))))
    # payloads go only to responses: one row per distinct payload where equal ones are revisits
    names = numbered.filter(~F.col("_revisit")).groupBy("_row").agg(F.collect_list("_capture").alias("names"))
    bodies = pages.select("_row", "digest", "url", "html").join(names, "_row").dropDuplicates(["_row"]).withColumn(
        "_capture", F.explode("names"))
    answer = _record(F.lit("response"), response, target, F.concat(status, F.col("html")),
                     "application/http;msgtype=response", digest)
    small = numbered.withColumn("_answer", F.when(F.col("_revisit"), revisit)).select(
        F.concat_ws("\r\n\r\n", request, metadata, "_answer").alias("value"))
    small.unionByName(bodies.select(answer.alias("value"))).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").text(path)


_RECORD = pa.schema([(c, pa.string()) for c in ("record_id", "type", "uri", "date", "concurrent_to", "refers_to",
                                               "declared_digest", "payload_digest")]
                    + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
_RECORD_DDL = ("record_id string, type string, uri string, date string, concurrent_to string, refers_to string, "
               "declared_digest string, payload_digest string, payload_bytes long, payload binary")


def _records(raw: bytes):
    """The records of an archive, gzipped as one or many members or plain: (headers, block)."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(raw))
            raw = member.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, raw[end + 4:end + 4 + size]
        if raw[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't as long as it says")
        at = end + 8 + size


def _parse(with_payload: bool, batch_bytes: int = 16 << 20):
    def run(batches):
        for batch in batches:
            for raw in batch["content"]:
                rows, held = [], 0
                for headers, block in _records(raw.as_py()):
                    kind = headers["WARC-Type"]
                    # the payload of an HTTP message is what follows its own headers
                    body = block.split(b"\r\n\r\n", 1)[1] if "application/http" in headers["Content-Type"] else block
                    keep = with_payload or kind == "metadata"
                    name = lambda c: (headers.get(c) or "").strip("<>") or None  # noqa: B023, E731
                    rows.append({
                        "record_id": name("WARC-Record-ID"), "type": kind, "uri": headers.get("WARC-Target-URI"),
                        "date": headers["WARC-Date"], "concurrent_to": name("WARC-Concurrent-To"),
                        "refers_to": name("WARC-Refers-To"),
                        "declared_digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                        "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(),
                        "payload_bytes": len(body), "payload": body if keep else None})
                    held += len(body) * keep + 500
                    if held > batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per WARC record below ``path``; digest and size are those of the payload as read. Without
    ``with_payload`` only metadata records keep theirs."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), _RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, uri, date, refers_to, payload_digest, payload_bytes, payload,
    requests and metadata (arrays of struct record_id, payload_bytes, payload).

    Requests and metadata join their response or revisit through WARC-Concurrent-To. A revisit has the digest, size and payload
    of the response that it refers to, by WARC-Refers-To; where that isn't in the archives, size and payload are null
    and the digest is the declared one. Records concurrent to nothing that is there are left out, as they belong to no
    capture. A response whose declared digest isn't that of its payload raises an error."""
    main = records.filter(F.col("type").isin("response", "revisit"))
    good = F.col("declared_digest").isNull() | (F.col("declared_digest") == F.col("payload_digest"))
    responses = main.filter("type = 'response'").withColumn("payload_digest", F.when(good, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("record_id")))))
    sources = responses.select(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("_digest"),
                               F.col("payload_bytes").alias("_bytes"), F.col("payload").alias("_payload"))
    revisits = main.filter("type = 'revisit'").join(sources, "refers_to", "left").select(
        "record_id", "type", "uri", "date", "refers_to", F.coalesce("_digest", "declared_digest").alias("payload_digest"),
        F.col("_bytes").alias("payload_bytes"), F.col("_payload").alias("payload"))
    captures = revisits.unionByName(responses.select(*revisits.columns))
    part = F.struct("record_id", "payload_bytes", "payload")
    beside = records.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).groupBy(
        F.col("concurrent_to").alias("record_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", part))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", part))).alias("metadata"))
    return captures.join(beside, "record_id", "left")


def page_id(metadata: Column) -> Column:
    """The page id in a capture's metadata."""
    return F.regexp_extract(F.element_at(metadata, 1)["payload"].cast("string"), r"pageId: (-?\d+)", 1).try_cast("long")
