"""ARC parsing, conversion and the round trip against the definition."""

import base64
import gzip
import hashlib
import io

from queryforge.llm import warc
from queryforge.llm.common import scratch_path

BODY = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n"
V1 = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain %d\n%s\n"
HEAD1 = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
HEAD2 = b"2 0 reserved x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for key, _, html in order:
        data = (html or "").encode()
        revisit = data in first
        out.append((key, len(data), b32(data), "revisit" if revisit else "response", first[data] if revisit else None))
        first.setdefault(data, key)
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(5, "http://a b/\n", "<p>x</p>"), (3, None, "<p>x</p>"), (3, "http://c", "<p>x</p>"), (9, "http://d", None), (1, "http://e", ""),
            (2, "http://f", "é" * 3000), (None, "http://g", "only"), (None, "http://h", "<p>x</p>"), (11, "http://i", "HTTP/1.1 200 OK\r\n\r\nfiledesc: x"),
            (-4, "http://j", "\r\n\r\nWARC/1.1\r\n"), *[(100 + i, f"http://hot/{i}", "hot") for i in range(300)]]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, record_type string, path int").repartition(6)
    got = warc.round_trip(pages).collect()
    assert all(r["valid"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows)


def test_empty_table_and_least_bytes(spark):
    schema = "page_id bigint, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abc"), (4, "x", "abc"), (5, "y", ""), (6, "z", None)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, schema), least_bytes=3).collect()}
    assert got == {i: ("response", None) for i in (1, 2, 3, 5, 6)} | {4: ("revisit", 3)}


def test_archives_are_rolled(spark):
    rows = [(i, f"http://u/{i}", "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(500))) for i in range(40)]
    arcs = warc.write_arc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), scratch_path(spark, "arc"), most_bytes=2000)
    assert arcs.count() > 3
    got = warc.read_warc(warc.convert(arcs, scratch_path(spark, "warc")))
    assert sorted(r["rank"] for r in got.collect()) == list(range(40))


def test_versions_and_damage():
    one = V1 % (len(HEAD1), HEAD1) + b"http://a/x y 1.2.3.4 19961231235959 text/html; charset=x 6\nabc\nde\n" + b"no header line\n" \
        + b"http://b 1.2.3.4 199612312359 text/plain 0\n\n" + b"http://c 1.2.3.4 19961231235959 text/plain 50\nshort"
    got = list(warc.arc_records(io.BytesIO(one)))
    assert [(r.url, r.ip, r.date, r.mime, r.body, r.whole) for r in got] == [
        ("http://a/x y", "1.2.3.4", "19961231235959", "text/html; charset=x", b"abc\nde", True),
        ("http://b", "1.2.3.4", "199612312359", "text/plain", b"", True), ("http://c", "1.2.3.4", "19961231235959", "text/plain", b"short", False)]
    two = V1 % (len(HEAD2), HEAD2) + b"http://a 1.2.3.4 20010203040506 text/html 200 SUM - 12 f.arc 3\nxyz\n" + b"http://b 1.2.3.4 20010203040506 text/html 3\nxyz\n"
    assert [r.url for r in warc.arc_records(io.BytesIO(two))] == ["http://a"]  # a line of the other version is none
    members = gzip.compress(V1 % (len(HEAD1), HEAD1)) + gzip.compress(b"http://a 1.2.3.4 20010203040506 t 4\nabcd\n") + gzip.compress(b"http://b 1.2.3.4 20010203040506 t 400\n" + b"".join(hashlib.sha256(bytes([i])).digest() for i in range(12)))[:-30]
    got = list(warc.arc_records(io.BytesIO(members)))
    assert [(r.url, r.whole) for r in got] == [("http://a", True), ("http://b", False)] and 200 < len(got[1].body) < 400
    assert list(warc.arc_records(io.BytesIO(b""))) == []


def test_records_are_equivalent():
    body = BODY + b"payload"
    r = warc.ArcRecord(12, "http://a", "1.2.3.4", "19961231235959", "text/html", body, True)
    found, = warc.warc_records(io.BytesIO(gzip.compress(warc.warc_record("a.arc", r, None))))
    h = found.headers
    assert (h["warc-type"], h["warc-date"], h["warc-target-uri"], h["warc-ip-address"]) == ("response", "1996-12-31T23:59:59Z", "http://a", "1.2.3.4")
    assert h["warc-payload-digest"] == "sha1:" + b32(b"payload") and h["warc-block-digest"] == "sha1:" + b32(body) and found.block == body
    assert h["warc-record-id"] == warc.record_id("a.arc", 12, "http://a", "19961231235959") != warc.record_id("a.arc", 13, "http://a", "19961231235959")
    dns, = warc.warc_records(io.BytesIO(warc.warc_record("a.arc", r._replace(body=b"text", mime="text/dns", whole=False), None)))
    assert dns.headers["warc-type"] == "resource" and dns.headers["content-type"] == "text/dns" and dns.headers["warc-truncated"] == "length"
    refers = {"record_id": "<urn:uuid:1>", "url": "http://b", "date": "1996-12-31T00:00:00Z"}
    again, = warc.warc_records(io.BytesIO(warc.warc_record("a.arc", r, refers)))
    assert again.headers["warc-type"] == "revisit" and again.block == BODY and again.headers["warc-refers-to"] == "<urn:uuid:1>"


def test_dates_and_ranks():
    assert warc.iso_date("1997") == "1970-01-01T00:00:00Z" and warc.iso_date("19971301000000") == "1970-01-01T00:00:00Z"
    assert warc.iso_date("199701021530") == "1997-01-02T15:30:00Z" and warc.iso_date("-") == "1970-01-01T00:00:00Z"
    rank = lambda v: warc._rank(b"HTTP/1.1 200 OK\r\nX-Page-Id: " + v + b"\r\n\r\n")
    assert rank(b"9223372036854775807") == 2**63 - 1 and rank(b"-9223372036854775808") == -2**63
    assert rank(b"9223372036854775808") is None and rank(b"x") is None and rank(b"") is None


def test_files_of_a_folder_and_lost_targets(spark):
    uri = scratch_path(spark, "arc")
    pages = spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", "x")], "page_id bigint, url string, html string")
    warc.write_arc(pages, uri)
    found = warc.archive_files(spark, uri)
    records = warc.read_warc(warc.convert(found, scratch_path(spark, "warc")))
    alone = warc.resolve(records.where("rank != 1")).collect()
    assert sorted((r["rank"], r["record_type"], r["payload_bytes"], r["refers_rank"]) for r in alone) == [(2, "revisit", None, None), (3, "response", 1, None)]
