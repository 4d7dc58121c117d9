"""WARC archives of captures, and their transactions put together again.

Writing: each page becomes three records, request, response (or revisit) and metadata,
tied by WARC-Concurrent-To. Records end with two CRLFs, so Spark's text writer with that
line separator writes the archive as it stands, payload bytes included, to any store.
Pages with equal payloads: the one with the smallest page_id is a response, the others
are revisits that carry the payload's digest and the reference, not the payload.

Reading: archives are read whole, one file at a time, split by Content-Length, and request,
response and metadata are joined through the concurrent-to identifiers to one nested row per
capture. Writing bounds a file by records and by bytes: pages are written by size class, larger
ones with fewer records to a file, about FILE_BYTES at most or a single page.

Defined results: a null html is an empty payload; equal pages with one page_id are all
responses; a null page_id never becomes the referred page, so where no page of a group has
an id, all are responses. A capture without a request or metadata record has null there;
of several, the one with the smallest record id is taken and ``n_requests``/``n_metadata``
give their numbers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.common import new_path, written

END = "\r\n\r\n"
ROWS_PER_FILE = 5_000
FILE_BYTES = 128 << 20
#: Payloads up to SMALL << 3k bytes are of class k.
SMALL = 48 << 10
#: The digits of base 32 that Spark counts in, and those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32(hexes: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 160 bits in four runs of 40."""
    runs = [F.lpad(F.conv(F.substring(hexes, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*runs), DIGITS, BASE32)


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to ``pages``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # the hash in a projection of its own: what uses it several times then computes it once
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("_sha1"), F.sha2("payload", 256).alias("_same"))
    same = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("_same", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n"))
    same = written(same.where("_n > 1 and refers_to is not null").drop("_n"), "warc-same")
    rows = rows.join(same, ["_same", "payload_bytes"], "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("_sha1")).alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("refers_to")).alias("refers_to"),
    )


def _head(kind: str, record_id, length, *more) -> Column:
    parts = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), record_id, *more]
    return F.concat(*parts, F.lit("\r\nContent-Length: "), length.cast("string"), F.lit(END))


def _field(name: str, value) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")


def records(rows: DataFrame) -> DataFrame:
    """The records of ``captures()`` rows as one binary column, three rows each."""
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    own = lambda kind: F.concat(F.lit(f"<urn:capture:{kind}:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.lower("payload_digest"), F.lit(">"))
    main = own("main")
    target = _field("WARC-Target-URI", url)
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"))
    reply = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    refers = F.concat(F.lit("<urn:capture:main:"), F.col("refers_to").cast("string"), F.lit(":"), F.lower("payload_digest"), F.lit(">"))
    reply_bytes = F.octet_length(reply)
    response = F.concat(F.encode(F.concat(_head("response", main, reply_bytes + F.col("payload_bytes"), target, digest), reply), "UTF-8"), F.col("payload"))
    profile = F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = F.encode(F.concat(_head("revisit", main, reply_bytes, target, digest, profile, _field("WARC-Refers-To", refers)), reply), "UTF-8")
    ask = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1" + END))
    request = F.encode(F.concat(_head("request", own("request"), F.octet_length(ask), target, _field("WARC-Concurrent-To", main)), ask), "UTF-8")
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\nrefers-to-page-id: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = F.encode(F.concat(_head("metadata", own("metadata"), F.octet_length(notes), target, _field("WARC-Concurrent-To", main)), notes), "UTF-8")
    first = F.when(F.col("record_type") == "response", response).otherwise(revisit)
    return rows.select(F.explode(F.array(request, first, metadata)).alias("record"))


def write_archives(rows: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes the records as .warc text files, one folder for each size class of pages.

    A file holds at most 3 * rows_per_file records, and so few that they fit ``file_bytes`` or
    belong to one page. ``rows`` are scanned once for each class that occurs.
    """
    size = F.col("payload_bytes")
    kind = F.when(size <= SMALL, 0).otherwise(F.ceil(F.log2(size / float(SMALL)) / 3)).cast("int")
    found = sorted(r[0] for r in rows.select(kind.alias("kind")).distinct().collect()) or [0]
    for k in found:
        most = max(1, min(rows_per_file, file_bytes // (SMALL << 3 * k)))
        own = rows.where(kind == k) if len(found) > 1 else rows
        lines = records(own).select(F.col("record").cast("string").alias("value"))
        lines.write.option("lineSep", END).option("maxRecordsPerFile", 3 * most).text(f"{path}/size{k}")


def split_records(data: bytes) -> Iterator[tuple[dict, memoryview]]:
    """The (headers, block) pairs of an archive's bytes; a repeated header keeps its last value."""
    view, at = memoryview(data), 0
    while (stop := data.find(b"\r\n\r\n", at)) >= 0:
        lines = bytes(view[at:stop]).decode("utf-8", "replace").split("\r\n")
        if not re.match(r"WARC/\d", lines[0]):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, view[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


RECORD = "type string, record_id string, concurrent_to string, refers_to string, target_uri string, stated_digest string, http string, body_bytes long, digest string, body binary"


def read_archives(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """One row per record. For HTTP records ``http`` is the header block and the body what
    follows it; body_bytes and digest (base32 SHA-1) come from the bytes read."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for head, block in split_records(data.as_py()):
                    body, http = block, None
                    if head["warc-type"] in ("response", "revisit", "request"):
                        text, _, body = bytes(block).partition(b"\r\n\r\n")
                        http = text.decode("utf-8", "replace")
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    keep = bytes(body) if with_body or head["warc-type"] == "metadata" else None
                    rows.append((head["warc-type"], head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, http, len(body), digest, keep))
                    held += len(keep or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def _batch(rows: list, names: list) -> pa.RecordBatch:
    kinds = {"body_bytes": pa.int64(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.string())) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per response or revisit record: capture_id, request, response, metadata.

    Requests and metadata are reduced to one row for each record they are concurrent to
    before the joins, so the joins never multiply rows. ``found`` should be a written table:
    it is read three times.
    """
    main = found.where(F.col("type").isin("response", "revisit"))
    response = F.struct("type", "target_uri", "refers_to", "stated_digest", "http", "body_bytes", "digest", "body").alias("response")
    out = main.select(F.col("record_id").alias("capture_id"), response)
    for kind, many in (("request", "n_requests"), ("metadata", "n_metadata")):
        side = found.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("capture_id"))
        fields = F.struct("record_id", "target_uri", "http", "body")
        out = out.join(side.agg(F.min(fields).alias(kind), F.count("*").alias(many)), "capture_id", "left")
    return out


def archived(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html), reads them back and assembles them.

    Adds page_id and refers_to_page as text from the metadata record, and payload_bytes
    and payload_digest: for a response of the bytes read, for a revisit as its headers say.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(captures(pages, min_bytes), path)
    found = written(read_archives(spark, path, with_body=False), "warc-records")
    rows = assemble(found)
    notes = F.decode("metadata.body", "UTF-8")
    note = lambda name: F.nullif(F.regexp_extract(notes, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    length = F.regexp_extract("response.http", r"(?i)content-length: ([0-9]+)", 1).cast("long")
    full = F.col("response.type") == "response"
    return rows.select(
        "*", note("page-id").alias("page_id"), note("refers-to-page-id").alias("refers_to_page"), F.col("response.type").alias("record_type"),
        F.when(full, F.col("response.body_bytes")).otherwise(length).alias("payload_bytes"), F.when(full, F.col("response.digest")).otherwise(F.col("response.stated_digest")).alias("payload_digest"),
    )
