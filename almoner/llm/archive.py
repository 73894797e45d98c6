"""Web archives: legacy ARC files converted to WARC, with duplicate payloads as revisits.

An ARC file is a ``filedesc`` line, a line with the format's version, a line that names the header fields, and records:
a header line of that version's fields and as many bytes as its last field declares.  The converter follows the declared
lengths, synthesises the WARC identifiers, dates, types and digests, and writes ``.warc.gz`` files through Spark's text
sink, whose line separator is the blank lines that end a record.  Reading follows ``Content-Length``.

Defined results: a null page is an empty payload; of records with equal payloads of at least ``LEAST`` bytes that with
the largest page_id is the response and the others are revisits of it, smaller ones are all responses; repeated rows
with the largest id are responses all; a null page_id is below all others; a null or empty URL becomes ``urn:x-none``,
and white space in one is percent-encoded; a
header line without an IP address, a date of 4 to 14 digits and a length where its version has them is an error; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner.llm.common import blobs, scratch_path, small

LEAST = 1000
#: Bytes of pages in an ARC file, and about that many before compression in a WARC file.
FILE_BYTES = 4 << 20
WARC_BYTES = 32 << 20
DATE = "20000101000000"
#: Fields of a record's header line, by the version that the file declares.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER, REFERS_HEADER = b"X-Page-Id", "X-Refers-To-Page-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-almoner:records")

ARC_SCHEMA = "path string, content binary"
RECORD_SCHEMA = "page_id long, uri string, ip string, date string, kind string, mime string, record_id string, block binary, payload_at long, payload_bytes long, payload_digest string"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: int | None
    block: bytes
    version: int


def arc_line(version: int, url: bytes, mime: bytes, length: int, status: int = 200, ip: str = "0.0.0.0", date: str = DATE, offset: int = 0, filename: str = "-") -> bytes:
    head = b" ".join((url, ip.encode(), date.encode(), mime))
    if version == 1:
        return b"%b %d\n" % (head, length)
    return b"%b %d - - %d %b %d\n" % (head, status, offset, filename.encode(), length)


def arc_start(version: int, filename: str, date: str = DATE) -> bytes:
    """The version block, itself a record of the declared length."""
    body = f"{version} 0 almoner\n{FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{filename}".encode(), b"text/plain", len(body), date=date, filename=filename) + body + b"\n"


#: A header line from the IP address on: URL and content type may hold spaces, so address, date and length fix the fields.
_LINES = {
    1: re.compile(rb"(?P<url>.*?) (?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+|-) (?P<date>[0-9]{4,14}) (?P<mime>.*) (?P<length>[0-9]+)"),
    2: re.compile(rb"(?P<url>.*?) (?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+|-) (?P<date>[0-9]{4,14}) (?P<mime>.*) (?P<status>[0-9]+|-) (?P<sum>\S+) (?P<location>\S+) (?P<offset>[0-9]+|-) (?P<file>\S+) (?P<length>[0-9]+)"),
}


def arc_header(version: int, line: bytes) -> dict[str, str] | None:
    """The fields of a record's header line by their names in FIELDS; None if it is none."""
    m = _LINES[version].fullmatch(line)
    return m and dict(zip(FIELDS[version].split(), (v.decode("utf-8", "replace") for v in m.groups()), strict=True))


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records by declared length; the first, the ``filedesc``, tells the version. Line feeds between records are skipped."""
    at, version = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header line without an end at {at}")
        line = data[at:end].rstrip(b"\r")
        if not version:
            if not line.startswith(b"filedesc://"):
                raise ValueError("no filedesc line")
            version = int(data[end + 1 : data.index(b"\n", end + 1)].split()[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        f = arc_header(version, line)
        if f is None:
            raise ValueError(f"no header line of version {version} at {at}")
        length = int(f["Archive-length"])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"a record cut short at {at}")
        yield ArcRecord(f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], int(f["Result-code"]) if version == 2 and f["Result-code"].isdigit() else None, block, version)
        at = end + 1 + length


def warc_date(date: str) -> str:
    """14 digits, or the leading part of them, as a WARC date."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(r: ArcRecord) -> str:
    if r.url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if r.block.startswith(b"HTTP/") else "resource"


def payload_start(block: bytes) -> int:
    """Where the payload begins in an HTTP message; 0 in any other block."""
    if not block.startswith(b"HTTP/"):
        return 0
    at = block.find(b"\r\n\r\n")
    return len(block) if at < 0 else at + 4


def http_header(block: bytes, name: bytes) -> bytes | None:
    for line in block[: payload_start(block)].split(b"\r\n"):
        if line[: len(name) + 1].lower() == name.lower() + b":":
            return line[len(name) + 1 :].strip()
    return None


def base32_digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.partition(":")[2]).hex()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record header at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"a record cut short at {at}")
        yield headers, block
        at = end + 8 + length


def _url(url: bytes) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url) if any(c <= 32 or c == 127 for c in url) else url or b"urn:x-none"


def arc_files(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages as legacy archives, rows (path, content) as Spark reads binary files; versions 1 and 2 take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, out, size = 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([f"{serial:06d}.arc"]), pa.array([b"".join(out)], pa.binary())], names=["path", "content"])

        for b in batches:
            for page, url, html in zip(b.column(0).to_pylist(), blobs(b.column(1)), blobs(b.column(2)), strict=True):
                version = serial % 2 + 1
                if not out:
                    out, size = [arc_start(version, f"{serial:06d}.arc")], 0
                own = b"" if page is None else b"%b: %d\r\n" % (PAGE_HEADER, page)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%bContent-Length: %d\r\n\r\n%b" % (own, len(html), html)
                out += [arc_line(version, _url(url), b"text/html", len(block), offset=size, filename=f"{serial:06d}.arc"), block, b"\n"]
                size += len(block)
                if size >= file_bytes:
                    yield close()
                    serial, out = serial + 1, []
        if out:
            yield close()

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, ARC_SCHEMA)


def arc_records(files: DataFrame, blocks: bool = True) -> DataFrame:
    """The records of ARC files (path, content) with their synthesised WARC fields; without ``blocks``, only digests."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64() if c in ("page_id", "payload_at", "payload_bytes") else pa.binary() if c == "block" else pa.string() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in parse_arc(content.as_py()):
                    if (kind := warc_type(r)) == "warcinfo":
                        continue  # describes the legacy file, not a page
                    at, page = payload_start(r.block), http_header(r.block, PAGE_HEADER)
                    digest = hashlib.sha1(memoryview(r.block)[at:]).hexdigest()
                    record_id = f"urn:uuid:{uuid.uuid5(_IDS, f'{r.url} {r.date} {page} {digest}')}"
                    rows.append((int(page) if page else None, r.url, r.ip, warc_date(r.date), kind, "application/http; msgtype=response" if kind == "response" else r.mime, record_id, r.block if blocks else None, at, len(r.block) - at, digest))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def responses(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each payload that more than one record has: payload_digest, payload_bytes, keep_page (the largest page_id)."""
    groups = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    return groups.agg(F.max("page_id").alias("keep_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def convert(files: DataFrame, path: str, least: int = LEAST, warc_bytes: int = WARC_BYTES) -> str:
    """Write the records of ARC files as WARC files under ``path``."""
    narrow = arc_records(files, blocks=False)
    size, n = narrow.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    keep = small(responses(narrow, least)).withColumnsRenamed({"payload_digest": "d", "payload_bytes": "b"})
    rows = arc_records(files).join(keep, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    rows = rows.withColumn("refers_to", F.when(F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep_page")), F.col("keep_page")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                headers = [("WARC-Type", "revisit" if r["refers_to"] is not None else r["kind"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", base32_digest(r["payload_digest"])), ("Content-Type", r["mime"])]
                block = r["block"]
                if r["refers_to"] is not None:
                    headers += [("WARC-Profile", REVISIT_PROFILE), (REFERS_HEADER, str(r["refers_to"]))]
                    block = block[: r["payload_at"]]
                headers.append(("WARC-Block-Digest", base32_digest(hashlib.sha1(block).hexdigest())))
                out.append(warc_record(headers, block))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    names = ["page_id", "uri", "ip", "date", "kind", "mime", "record_id", "block", "payload_at", "payload_digest", "refers_to"]
    warc = rows.select(*names).mapInArrow(run, "record binary")
    per_file = max(1, int(warc_bytes // max(1, size // max(1, n))))
    warc.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``; digests of responses are those of the bytes read."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.int64() if c in ("page_id", "payload_bytes", "refers_to") else pa.string() for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse_warc(gzip.decompress(content.as_py())):
                    at, page = payload_start(block), http_header(block, PAGE_HEADER)
                    if h["warc-type"] == "revisit":
                        n, digest = int(http_header(block, b"Content-Length")), hex_digest(h["warc-payload-digest"])
                    else:
                        n, digest = len(block) - at, hashlib.sha1(memoryview(block)[at:]).hexdigest()
                        if digest != hex_digest(h["warc-payload-digest"]):
                            raise ValueError(f"{h['warc-record-id']}: its payload is not that of its digest")
                    refers = h.get(REFERS_HEADER.lower())
                    rows.append((int(page) if page else None, n, digest, h["warc-type"], int(refers) if refers else None, h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), h["warc-date"]))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("content").mapInArrow(run, READ_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC to WARC files in the shared folder and back: one row per page."""
    path = scratch_path(pages.sparkSession, "warc")
    convert(arc_files(pages), path)
    return read_warc(pages.sparkSession, path)


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest AS d, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id <> keep THEN keep END AS refers_to
FROM p LEFT JOIN k ON payload_digest = d AND payload_bytes >= 1000
"""
