import gzip
import hashlib
from collections import defaultdict

import pytest

from almoner.llm import archive
from almoner.llm.common import scratch_path


def test_versions_lengths_and_odd_urls():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n" + archive.arc_line(1, b"http://fake", b"text/html", 3) + b"abc\n\n"
    for v in (1, 2):
        data = archive.arc_start(v, "f.arc") + archive.arc_line(v, b"http://x/a b", b"text/html", len(body), status=404) + body + b"\n\n" + archive.arc_line(v, b"dns:x", b"text/dns", 3) + b"abc\n"
        got = list(archive.parse_arc(data))
        assert [(r.url, archive.warc_type(r), r.mime, r.version) for r in got] == [("filedesc://f.arc", "warcinfo", "text/plain", v), ("http://x/a b", "response", "text/html", v), ("dns:x", "resource", "text/dns", v)]
        assert got[1].block == body and got[2].block == b"abc" and got[1].status == (404 if v == 2 else None)
        assert archive.http_header(body, b"x-page-id") == b"7"
        with pytest.raises(ValueError):
            list(archive.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(archive.parse_arc(b"http://x 0 0 text/html 0\n"))


def test_synthesised_fields():
    assert archive.warc_date("20100203040506") == "2010-02-03T04:05:06Z" and archive.warc_date("2010") == "2010-01-01T00:00:00Z"
    d = hashlib.sha1(b"x").hexdigest()
    assert archive.hex_digest(archive.base32_digest(d)) == d


def test_warc_framing_is_by_length():
    block = b"a\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"
    data = (archive.warc_record([("WARC-Type", "resource")], block) + b"\r\n\r\n") * 2
    assert [b for _, b in archive.parse_warc(data)] == [block, block]
    with pytest.raises(ValueError):
        list(archive.parse_warc(data[:-1]))


def brute(rows):
    payload = lambda h: (h or "").encode()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[payload(h)].append(i)
    out = []
    for i, _, h in rows:
        p = payload(h)
        known = [x for x in groups[p] if x is not None]
        keep = max(known) if known and len(p) >= 1000 else i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if i == keep else "revisit", None if i == keep else keep))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 999), (4, "", "x" * 999), (5, "http://a/b c\n", None), (6, "http://a/6", ""),
    (7, "http://ü/7", "é" * 700 + "\r\n\r\nWARC/1.0\r\n"), (8, "http://ü/7", "é" * 700 + "\r\n\r\nWARC/1.0\r\n"), (None, "http://n", "x" * 1000), (2, "http://a/2", "x" * 1000), (9, "u", "long " * 300_000), (None, "n", "y" * 2000), (None, "n", "y" * 2000),
]
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_pages_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, block string")
    got = archive.archive_pages(df)
    assert sorted((tuple(r) for r in got.select(NAMES).collect()), key=repr) == brute(ROWS)
    assert archive.archive_pages(df.limit(0)).isEmpty()


def test_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    path = archive.convert(archive.arc_files(df, file_bytes=5000), scratch_path(spark, "warc"), warc_bytes=100_000)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 1
    records = [r for f in files for r in archive.parse_warc(gzip.decompress(f.content))]
    assert len(records) == len(ROWS) and all(h["warc-record-id"].startswith("<urn:uuid:") and h["warc-block-digest"].startswith("sha1:") for h, _ in records)
    assert {h["warc-type"] for h, _ in records} == {"response", "revisit"}


def test_header_lines_are_split_by_address_date_and_length():
    one = archive.arc_header(1, b"http://x/a b 1.2.3.4 20100203040506 text/html; charset=x 17")
    assert one == {"URL": "http://x/a b", "IP-address": "1.2.3.4", "Archive-date": "20100203040506", "Content-type": "text/html; charset=x", "Archive-length": "17"}
    two = archive.arc_header(2, b"http://x/ ::1 20100203040506 text/html; charset=x 200 - - 5 a.arc 17")
    assert (two["URL"], two["IP-address"], two["Content-type"], two["Result-code"], two["Archive-length"]) == ("http://x/", "::1", "text/html; charset=x", "200", "17")
    for bad in (b"http://x/ 20100203040506 text/html 17", b"http://x/ 1.2.3.4 text/html 17", b"http://x/ 1.2.3.4 20100203040506 text/html", b""):
        assert archive.arc_header(1, bad) is None
