"""WARC archives: writing captures as record triples, reading them back, assembling transactions."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, table

# The separator that ends a record, the profile of a revisit, digits of two base-32 alphabets.
RECORD_END = "\r\n\r\n"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of records, before compression, that one archive holds.
ARCHIVE_BYTES = 16 << 20

_RECORD = ("record_id string, type string, concurrent_to string, refers_to string, url string, date string, "
           "payload_digest string, computed_digest string, payload_bytes long, fields map<string,string>, payload binary")


def base32_of_hex(digest: Column) -> Column:
    """40 hexadecimal digits as 32 digits of base 32: five of one are four of the other."""
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def _record_id(kind: str, *parts: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # concat_ws leaves out nulls
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), block)


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """(pid, page_id, url, html, sha, dup, lead, response): which rows are responses.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest
    ``page_id`` is the response; if that page repeats, its first row.  The search for the
    largest id sees narrow rows and is combined on the map side; the payloads move once, by
    page and payload, so a payload that a third of all pages share is spread like any other.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("pid"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]+", "%0A").alias("url"),
        html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    pairs = keyed.groupBy("pid", "sha").agg(F.min("page_id").alias("page_id"))
    lead = pairs.groupBy("sha").agg(F.max("page_id").alias("lead"))
    leads = pairs.join(lead, "sha").select("pid", "sha", F.coalesce(F.col("lead").cast("string"), F.lit("null")).alias("lead"))
    numbered = keyed.withColumn("dup", F.row_number().over(Window.partitionBy("pid", "sha").orderBy("url")) - 1)
    joined = numbered.join(leads, ["pid", "sha"])
    first = (F.col("pid") == F.col("lead")) & (F.col("dup") == 0)
    return joined.withColumn("response", first | (F.octet_length("html") < least))


def write_archives(pages: DataFrame, path: str, date: str, least: int = 0) -> None:
    """Writes request, response or revisit, and metadata records of every page.

    A record's text ends with the separator that the text sink puts between rows, so the sink's
    commit protocol serves: a lost executor leaves no half archive.  Archives hold about
    ``ARCHIVE_BYTES`` each.  A null ``html`` is the empty payload; a null ``url`` the empty
    address; null and repeated page ids are captures like others; further columns are not read.
    """
    size = pages.agg(F.avg(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit("")))).alias("n")).first()["n"]
    rows = captures(pages, least)
    dup = F.col("dup").cast("string")
    own = _record_id("capture", F.col("pid"), F.col("sha"), dup)
    rows = rows.withColumn("own", own).withColumn("digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    target = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    path_of = F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", "")
    get = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(" HTTP/1.1\r\nHost: "),
                   F.regexp_extract("url", r"^[a-zA-Z]+://([^/]*)", 1), F.lit("\r\n\r\n"))
    request = _record("request", [("WARC-Record-ID", _record_id("request", F.col("pid"), F.col("sha"), dup)),
                                  ("WARC-Concurrent-To", F.col("own")), *target], "application/http;msgtype=request", get)
    answer = _record(
        F.when(F.col("response"), "response").otherwise("revisit"),
        [("WARC-Record-ID", F.col("own")), *target, ("WARC-Payload-Digest", F.col("digest")),
         ("WARC-Profile", F.when(~F.col("response"), F.lit(IDENTICAL_PAYLOAD))),
         ("WARC-Refers-To", F.when(~F.col("response"), _record_id("capture", F.col("lead"), F.col("sha"), F.lit("0"))))],
        "application/http;msgtype=response", F.concat(http, F.when(F.col("response"), F.col("html")).otherwise("")))
    about = _record("metadata", [("WARC-Record-ID", _record_id("metadata", F.col("pid"), F.col("sha"), dup)),
                                 ("WARC-Concurrent-To", F.col("own")), *target], "application/warc-fields",
                    F.concat(F.lit("page-id: "), F.col("pid"), F.lit("\r\n")))
    (rows.select(F.explode(F.array(request, answer, about)).alias("value"))
     .write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", max(30, int(3 * ARCHIVE_BYTES / ((size or 0) + 1500)))).text(path))


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in lines.split(b"\r\n") if b":" in line)
    return {k.decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _unpacked(data: bytes) -> bytes:
    """All members of a gzip file, one after the other; zeros after the last one are padding."""
    parts = []
    while data:
        member = zlib.decompressobj(47)
        parts.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member of an archive is cut off")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def _records(archive: bytes):
    """(headers, block) of each record; a block ends by its stated length, whatever it holds."""
    at = 0
    while (at := archive.find(b"WARC/", at)) >= 0:
        end = archive.index(b"\r\n\r\n", at)
        headers = _fields(archive[at:end])
        n = int(headers.get("content-length", 0))
        yield headers, archive[end + 4:end + 4 + n]
        at = end + 4 + n


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives; digests and sizes are those of the bytes read."""
    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                archive = _unpacked(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for headers, block in _records(archive):
                    kind, payload, size, computed, fields = headers.get("warc-type"), None, None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, computed = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    elif kind == "metadata":
                        fields = list(_fields(block).items())
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"),
                                 headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"),
                                 headers.get("warc-payload-digest"), computed, size, fields, payload if payloads else None))
                types = [pa.string()] * 8 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
                names = [f.split()[0] for f in _RECORD.replace("map<string,string>", "map").split(", ")]
                for k in range(0, len(rows), 256):
                    columns = zip(*rows[k:k + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, _RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, ``capture``, ``requests``, ``metadata``, ``original``.

    Requests and metadata name the capture they belong to as concurrent; a capture without
    them has empty lists, and one that names an unknown original has a null ``original``.
    ``original`` is the response a revisit refers to.  Records concurrent to no capture give no row.
    """
    def concurrent(kind: str, name: str, *columns: str) -> DataFrame:
        own = records.filter(F.col("type") == kind).select("concurrent_to", F.struct("record_id", *columns).alias("r"))
        return own.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.sort_array(F.collect_list(F.struct(
            F.col("r.record_id"), *[(F.map_entries("r.fields") if c == "fields" else F.col(f"r.{c}")).alias(c) for c in columns]))).alias(name))

    capture = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("type", "url", "date", "payload_digest", "computed_digest", "payload_bytes", "payload",
                              "refers_to").alias("capture"))
    whole = capture.join(concurrent("request", "requests", "url", "date"), "record_id", "left")
    whole = whole.join(concurrent("metadata", "metadata", "fields"), "record_id", "left")
    whole = whole.select("record_id", "capture", *[F.coalesce(c, F.array()).alias(c) for c in ("requests", "metadata")])
    original = whole.filter(F.col("capture.type") == "response").select(
        F.col("record_id").alias("_o"), F.struct(
            "record_id", F.col("capture.payload_bytes").alias("payload_bytes"), F.col("metadata").alias("metadata")).alias("original"))
    return whole.join(original, whole["capture.refers_to"] == original["_o"], "left").drop("_o")


def _page_id(metadata: Column) -> Column:
    entry = F.filter(F.flatten(F.transform(metadata, lambda m: m["fields"])), lambda f: f["key"] == "page-id")
    return F.try_element_at(entry, F.lit(1))["value"].try_cast("long")


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, date="2026-01-01T00:00:00Z")
    rows = transactions(read_records(spark, path, payloads=False))
    return rows.select(
        _page_id(F.col("metadata")).alias("page_id"),
        F.coalesce("capture.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce(F.col("capture.computed_digest"), F.regexp_replace("capture.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"), _page_id(F.col("original.metadata")).alias("refers_to"))
