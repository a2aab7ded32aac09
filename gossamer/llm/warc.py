"""WARC writing, reading and transaction assembly.

Archives are plain WARC/1.1 streams. They are written by Spark's text writer (a value is
written byte for byte) and read by its binary reader, so any file system Spark knows works.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm.groups import attach_groups
from gossamer.session import materialize, scratch, table, trimmed

#: The digit alphabets of base 32 as conv() writes them and as RFC 4648 does.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Pages of an archive at most: an archive is read as one row, so it has to stay small.
FILE_PAGES = 1000
#: A capture with more attachments than this is emitted in several parts.
PART_SIZE = 1000

PRIMARY = ("response", "revisit", "resource")

RECORDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("declared_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORDS_DDL = "record_id string, record_type string, concurrent_to array<string>, target_uri string, refers_to string, payload_digest string, declared_bytes bigint, payload_bytes bigint, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1 without leaving the JVM: 40 bits are 8 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), CONV32, RFC32)


def record_uuid(page_id: Column, kind: int, tag: Column) -> Column:
    """A version-8 UUID that carries the page id (64 bits), the record's kind and a tag of the row (32 bits)."""
    h = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0)).cast("long")), 16, "0"))
    null = F.when(page_id.isNull(), F.lit("8001")).otherwise(F.lit("8000"))
    t = F.lower(F.lpad(F.hex(tag), 8, "0"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit(f"-8{kind:x}00-"), null, F.lit("-"), t, F.substring(h, 13, 4), F.lit(">"))


def page_of(record_id: Column) -> Column:
    """The page id that ``record_uuid`` put into a record id."""
    h = F.concat(F.substring(record_id, 11, 8), F.substring(record_id, 20, 4), F.substring(record_id, 43, 4))
    return F.when(F.substring(record_id, 30, 4) == "8001", F.lit(None)).otherwise(F.conv(h, 16, -10).cast("long"))


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, tag, and first: page_id and tag of the equal payload with the smallest page_id.

    Null html is an empty payload, a null url leaves the header out, and a null page_id sorts
    after all others. Exactly repeated rows get records of equal ids. Columns other than
    page_id, url and html are not read, so their names do not matter.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", F.when(F.col("n_bytes") >= min_bytes, F.concat_ws(":", "digest", "n_bytes")))
    rows = rows.withColumn("tag", F.crc32(F.concat_ws(" ", "url", "digest")))
    return attach_groups(rows, "key", {"first": F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "tag")))}, "warc-firsts")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Three records a page: request, response (or revisit of an equal payload) and metadata.

    Request and metadata name the response in WARC-Concurrent-To. Duplicates of a payload of at
    least ``min_bytes`` become revisit records that keep the HTTP headers, not the payload; they refer to
    the record id of the response. A file is one gzip member, whatever the number of its records.
    """
    rows = plan_records(pages, min_bytes)
    crlf = "\r\n"
    url = F.regexp_replace("url", r"[\r\n]", "")
    rid, qid, mid = (record_uuid(F.col("page_id"), k, F.col("tag")) for k in (1, 2, 3))
    first = F.col("first.page_id")
    revisit = first.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > first))
    target = F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit(crlf))).otherwise(F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(crlf * 2))
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: "), record_uuid(first, 1, F.col("first.tag")), F.lit(crlf))).otherwise(F.lit(""))

    def record(kind: Column, ident: Column, extra: Column, mime: str, block: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1{crlf}WARC-Type: "), kind, F.lit(f"{crlf}WARC-Record-ID: "), ident, F.lit(f"{crlf}WARC-Date: {date}{crlf}"), target, extra,
            F.lit(f"Content-Type: {mime}{crlf}Content-Length: "), F.octet_length(block).cast("string"), F.lit(crlf * 2), block, F.lit(crlf * 2),
        )

    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), rid, F.lit(crlf))
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    request = record(F.lit("request"), qid, concurrent, "application/http; msgtype=request", F.concat(F.lit(f"GET / HTTP/1.1{crlf}Host: "), host, F.lit(crlf * 2)))
    response = record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), rid, F.concat(refers, F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(crlf)), "application/http; msgtype=response", body)
    metadata = record(F.lit("metadata"), mid, concurrent, "application/warc-fields", F.concat(F.lit("payloadBytes: "), F.col("n_bytes").cast("string"), F.lit(crlf)))
    text = F.concat(request, response, metadata)
    # the writer ends each value with the line feed that ends the last record
    rows.select(F.left(text, F.length(text) - 1).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES).text(path)


def parse_warc(raw: bytes, with_payload: bool = True) -> Iterator[dict]:
    """Records of one archive (plain, or gzip in one or many members), found by Content-Length."""
    if raw[:2] == b"\x1f\x8b":
        out, rest = [], raw
        while rest[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            out.append(d.decompress(rest))
            rest = d.unused_data
        raw = b"".join(out)
    at, end = 0, len(raw)
    while at < end:
        start = raw.find(b"WARC/", at)
        if start < 0:
            return
        stop = raw.find(b"\r\n\r\n", start)
        if stop < 0:
            return
        single: dict[str, str] = {}
        concurrent: list[str] = []
        for line in raw[start:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            name, value = k.strip().lower().decode("latin-1"), v.strip().decode("utf-8", "replace")
            if name == "warc-concurrent-to":
                concurrent.append(value)
            else:
                single.setdefault(name, value)
        size = int(single.get("content-length") or 0)
        block = raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4
        declared, payload = None, block
        if single.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            head, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (block, b"")
            for line in head.split(b"\r\n"):
                if line.lower().startswith(b"content-length:"):
                    declared = int(line.split(b":", 1)[1])
        kind = single.get("warc-type")
        digest = (single.get("warc-payload-digest") or "").rpartition(":")[2] or None
        if kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "record_id": single.get("warc-record-id"), "record_type": kind, "concurrent_to": concurrent, "target_uri": single.get("warc-target-uri"),
            "refers_to": single.get("warc-refers-to"), "payload_digest": digest, "declared_bytes": declared,
            "payload_bytes": len(payload), "payload": payload if with_payload else None,
        }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, batch: int = 256) -> DataFrame:
    """One row per record of every archive below ``path``; batches stay small, whatever an archive holds."""

    def parse(batches):
        for b in batches:
            rows = []
            for raw in b.column(0):
                for r in parse_warc(raw.as_py(), with_payload):
                    rows.append(r)
                    if len(rows) >= batch:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(trimmed(parse), RECORDS_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response, requests and metadata joined through concurrent-to.

    A link counts in either direction, and may lead over another request or metadata record. A
    record that leads to no response is a capture of its own without a response. A capture with
    more than 1,000 attachments is emitted in parts (``part`` 0, 1, ...; the response in part 0),
    so no unbounded group is collected. Records without an id are dropped from no one: they are
    captures of their own (``capture_id`` null). Records of one id are one capture, and
    ``n_copies`` counts its responses; an equal request or metadata record is listed once.
    """
    facts = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "declared_bytes", "payload_bytes", "payload"]
    primary = F.col("record_type").isin(*PRIMARY)
    ids = records.where(primary & F.col("record_id").isNotNull()).select(F.col("record_id").alias("to_id")).distinct()
    out = records.select("record_id", primary.alias("p"), F.explode("concurrent_to").alias("to_id"))
    links = out.where("not p").select(F.col("record_id").alias("from_id"), "to_id").unionByName(out.where("p").select(F.col("to_id").alias("from_id"), F.col("record_id").alias("to_id")))
    one = links.join(ids, "to_id").groupBy("from_id").agg(F.min("to_id").alias("capture_id"))
    # a second step leads over a record that the first has placed
    over = one.select(F.col("from_id").alias("to_id"), "capture_id")
    two = links.join(over, "to_id").groupBy("from_id").agg(F.min("capture_id").alias("capture_id"))
    step = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2))).groupBy("from_id").agg(F.min_by("capture_id", "hop").alias("capture_id"))
    placed = records.join(step.withColumnRenamed("from_id", "record_id"), "record_id", "left")
    placed = placed.withColumn("capture_id", F.when(primary, F.col("record_id")).otherwise(F.coalesce("capture_id", "record_id")))
    sizes = placed.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_SIZE)
    placed = placed.join(sizes, "capture_id", "left")
    part = F.when(primary | F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("record_id"), F.ceil(F.col("n") / PART_SIZE))).cast("int")
    lone = F.when(F.col("record_id").isNull(), F.xxhash64(*[c for c in facts if c != "payload"]))
    placed = placed.withColumn("part", part).withColumn("lone", lone).withColumn("rec", F.struct(*facts))
    side = lambda kind: F.sort_array(F.collect_set(F.when(F.col("record_type") == kind, F.struct(*facts))))
    return placed.groupBy("capture_id", "part", "lone").agg(
        F.min_by(F.when(primary, F.col("rec")), F.when(primary, F.struct("record_type", "payload_digest", "payload_bytes"))).alias("response"),
        side("request").alias("requests"), side("metadata").alias("metadata"),
        F.count(F.lit(1)).alias("n_records"), F.count_if(primary).alias("n_copies"),
    ).drop("lone")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a transaction per page, read the archives back, assemble, and describe each page's capture.

    Rows that are repeated throughout are one capture, and as many rows of the result.
    """
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    captures = assemble(materialize(read_archives(spark, path, with_payload=False), "warc-records")).where("response is not null")
    r = F.col("response")
    each = captures.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return each.select(
        page_of(r.record_id).alias("page_id"), F.when(r.record_type == "revisit", r.declared_bytes).otherwise(r.payload_bytes).alias("payload_bytes"),
        r.payload_digest.alias("payload_digest"), r.record_type.alias("record_type"), page_of(r.refers_to).alias("refers_to"),
        r.target_uri.alias("url"), F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     d AS (SELECT *, strlen(h) AS n, sha1(h) AS hx, min(page_id) OVER (PARTITION BY h) AS f FROM p),
     c AS (SELECT *, [substr(hx, 1, 10), substr(hx, 11, 10), substr(hx, 21, 10), substr(hx, 31, 10)] AS parts FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda x: array_to_string(list_transform(range(0, 8),
         lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || x AS BIGINT) >> CAST(35 - 5 * i AS INT)) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > f THEN f END AS refers_to, url,
       CAST(1 AS INT) AS n_requests, CAST(1 AS INT) AS n_metadata
FROM c
"""
