"""Legacy archive converter: ARC files, versions 1 and 2, into WARC files.

1. ``convert`` streams every ARC file in a task: the version block names the header fields, each
   header line declares the length of its body.  A first pass yields one narrow row for each record,
   with the digests of its payload.
2. Spark finds, for each payload, the record that stays a response (smallest rank, then date, file
   and offset); the others become revisits.  Payloads that many records share join by broadcast.
3. A second pass streams each ARC file again and writes the WARC file of the same name: identifiers
   from file, offset, URL and date; timestamps in ISO 8601; types from the body; SHA-1 digests.

No payload is shuffled.  An archive is one task's work; ``write_arc`` begins a new one at ``most_bytes``.

Damaged input: header lines that are not of the file's version are skipped up to the next one that is;
a body that ends before its declared length, or in a damaged gzip member, is kept as far as it goes, with
``WARC-Truncated: length``.  A date that is no date becomes 1970-01-01T00:00:00Z.  Files are streams
of gzip members, one for each record, or plain.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path
from .files import one_task_each, opened, written

#: Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_VERSION_LINE = {1: "1 0 queryforge", 2: "2 0 reserved queryforge"}
ARC_LINE = {1: re.compile(rb"(.+) ([0-9A-Fa-f.:-]+) (\d{8,17}|-) (.+) (\d+)"),
            2: re.compile(rb"(.+) ([0-9A-Fa-f.:-]+) (\d{8,17}|-) (.+) (\d+|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)")}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "19700101000000"
#: Header of the archived HTTP response that carries the integer rank of a record.
RANK_HEADER = "X-Page-Id"

_ENDS = (EOFError, gzip.BadGzipFile, zlib.error)


class ArcRecord(NamedTuple):
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    whole: bool


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes
    whole: bool


def _stream(raw) -> io.BufferedIOBase:
    """The uncompressed bytes of a file, whatever its form."""
    raw = io.BufferedReader(raw, 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _line(stream) -> bytes:
    """The next line with its end; empty at the end of the file, also in a damaged one."""
    try:
        return stream.readline()
    except _ENDS:
        return b""


def _body(stream, length: int) -> bytes:
    """``length`` bytes, or as many as there are."""
    parts, left = [], length
    try:
        while left and (part := stream.read1(min(left, 1 << 20))):  # read() would lose what came before the damage
            parts.append(part)
            left -= len(part)
    except _ENDS:
        pass
    return b"".join(parts)


def arc_records(raw) -> Iterator[ArcRecord]:
    """Records of one ARC file, without the version blocks; a file without one counts as version 1."""
    stream, version = _stream(raw), 1
    while True:
        offset = stream.tell()
        line = _line(stream)
        if not line:
            return
        line = line.rstrip(b"\r\n")
        if line.startswith(b"filedesc:"):
            length = int(line.rsplit(b" ", 1)[-1]) if line.rsplit(b" ", 1)[-1].isdigit() else 0
            if (block := _body(stream, length)).split(b" ", 1)[0].strip() in (b"1", b"2"):
                version = int(block[:1])
            continue
        found = ARC_LINE[version].fullmatch(line)
        if not found:
            continue
        length = int(found[found.re.groups])
        body = _body(stream, length)
        url, ip, date, mime = (x.decode("utf-8", "replace") for x in found.groups()[:4])
        yield ArcRecord(offset, url, ip, date, mime, body, len(body) == length)


def http_parts(body: bytes) -> tuple[bytes, bytes] | None:
    """(headers with their empty line, payload) of an HTTP response; None of any other body."""
    if not body.startswith(b"HTTP/"):
        return None
    ends = [m.end() for m in (re.search(rb"\r?\n\r?\n", body),) if m]
    return (body[:ends[0]], body[ends[0]:]) if ends else (body, b"")


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _rank(head: bytes) -> int | None:
    value = http_header(head, RANK_HEADER) or ""
    rank = int(value) if re.fullmatch(r"-?\d{1,19}", value) else None
    return rank if rank is not None and -2**63 <= rank < 2**63 else None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """An ARC date (8 to 17 digits) as WARC-Date."""
    try:
        return datetime.strptime((date + "000000")[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(archive: str, offset: int, url: str, date: str) -> str:
    """The same record of the same file always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset} {date} {url}')}>"


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _member(data: bytes, level: int) -> bytes:
    return gzip.compress(data, level, mtime=0)


class _Archives:
    """Archives of one task, a new one whenever ``most_bytes`` are written; ``files`` lists (path, records)."""

    def __init__(self, uri: str, most_bytes: int, suffix: str):
        self.uri, self.most, self.suffix, self.files = uri, most_bytes, suffix, []
        self.stack = self.out = None

    def add(self, record: bytes, begin) -> None:
        if self.out is None or self.out.tell() >= self.most:
            self.close()
            name = f"part-{TaskContext.get().partitionId():06d}-{len(self.files):04d}{self.suffix}"
            self.stack = ExitStack()
            self.out = self.stack.enter_context(written(self.uri, name))
            self.files.append([f"{self.uri}/{name}", 0])
            self.out.write(begin(name))
        self.out.write(record)
        self.files[-1][1] += 1

    def close(self) -> None:
        if self.stack:
            self.stack.close()
            self.stack = self.out = None


_MANIFEST = "path string, records bigint"


def _manifest(files: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], ["path", "records"])


def write_arc(pages: DataFrame, uri: str, most_bytes: int = 100_000_000, level: int = 1, id_col: str = "page_id",
              url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Every row of ``pages`` as a record of an ARC archive below ``uri``: rows (path, records), one for each archive.

    Files of even partitions are of version 1, those of odd ones of version 2.  A null body is empty, a null URL
    ``about:blank``, a null id leaves its header out; blanks and control characters of a URL are escaped.
    Repeated rows are repeated records; other columns are ignored; an empty table writes no archive.
    """
    def begin_of(version: int):
        def begin(name: str) -> bytes:
            block = f"{ARC_VERSION_LINE[version]}\n{ARC_FIELDS[version]}\n".encode()
            tail = f"200 - - 0 {name} " if version == 2 else ""
            return _member(f"filedesc://{name} 0.0.0.0 {NO_DATE} text/plain {tail}{len(block)}\n".encode() + block + b"\n", level)
        return begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        archives, begin = _Archives(uri, most_bytes, ".arc.gz"), begin_of(version)
        for batch in batches:
            for key, url, body in zip(*(batch.column(i) for i in range(3))):
                key, url, body = key.as_py(), url.as_py() or b"about:blank", body.as_py() or b""
                url = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)
                own = f"{RANK_HEADER}: {key}\r\n" if key is not None else ""
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body
                tail = f"200 {digest(body)} - {archives.out.tell() if archives.out else 0} - " if version == 2 else ""
                line = url + f" 0.0.0.0 {NO_DATE} text/html {tail}{len(body)}\n".encode()
                archives.add(_member(line + body + b"\n", level), begin)
        archives.close()
        yield _manifest(archives.files)

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").cast("binary").alias("url"),
                        F.col(body_col).cast("string").cast("binary").alias("body"))
    return materialize(rows.mapInArrow(run, _MANIFEST), "arc-files")


def archive_files(spark: SparkSession, folder: str, pattern: str = "*.arc*") -> DataFrame:
    """(path) of the archives in a folder, for ``convert`` and ``read_warc``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")


_DIGESTS = "path string, offset bigint, record_id string, url string, date string, rank bigint, payload_bytes bigint, payload binary"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in _DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = []
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with opened(path) as raw:
                for r in arc_records(raw):
                    head, payload = http_parts(r.body) or (b"", r.body)
                    rows.append((path, r.offset, record_id(_name(path), r.offset, r.url, r.date), r.url, iso_date(r.date), _rank(head),
                                 len(payload), hashlib.sha256(payload).digest()))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
    if rows:
        yield batch_of(rows)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (at most one row for each key), both materialised.

    The keys that hold more than 1/``share`` of the rows, fewer than ``share`` of them, join by broadcast; the rest by a
    shuffle in which no key has more than that part.
    """
    total = rows.count()
    hot = materialize(rows.groupBy(key).count().where(F.col("count") * share > total).select(key), "hot-keys")
    hot_facts = facts.join(F.broadcast(hot), key, "left_semi")
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(hot_facts), key).unionByName(rest)


def _revisits(records: DataFrame, least_bytes: int) -> DataFrame:
    """(path, revisits): what each revisit of a file refers to, by offset; bounded by the records of one archive."""
    records = records.where(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("rank").isNull(), F.coalesce("rank", F.lit(0)), "date", "path", "offset")
    heads = (records.groupBy("payload").agg(F.min_by(F.struct("path", "offset", "record_id", "url", "date"), order).alias("head"), F.count("*").alias("n"))
             .where("n > 1").select("payload", "head"))
    heads = materialize(heads, "warc-heads")
    shared = materialize(records.select("payload", "path", "offset").join(heads, "payload", "left_semi"), "warc-shared")
    found = join_facts(shared, heads, "payload").where("path != head.path or offset != head.offset")
    return found.groupBy("path").agg(F.collect_list(F.struct("offset", "head.record_id", "head.url", "head.date")).alias("revisits"))


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **headers, "Content-Length": len(block)}.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def warc_record(archive: str, r: ArcRecord, refers: dict | None) -> bytes:
    """The WARC record of an ARC record: response or revisit of an HTTP response, resource of any other body."""
    parts = http_parts(r.body)
    head, payload = parts or (b"", r.body)
    headers = {"WARC-Record-ID": record_id(archive, r.offset, r.url, r.date), "WARC-Date": iso_date(r.date), "WARC-Target-URI": r.url}
    if re.search(r"[1-9A-Fa-f]", r.ip):
        headers["WARC-IP-Address"] = r.ip
    headers["Content-Type"] = "application/http; msgtype=response" if parts else r.mime
    headers["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    kind, block = "response" if parts else "resource", r.body
    if refers:
        kind, block = "revisit", head
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers["record_id"], "WARC-Refers-To-Target-URI": refers["url"],
                    "WARC-Refers-To-Date": refers["date"]}
    elif not r.whole:
        headers["WARC-Truncated"] = "length"
    headers["WARC-Block-Digest"] = f"sha1:{digest(block)}"
    return _record(kind, headers, block)


def convert(archives: DataFrame, uri: str, least_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write a WARC file below ``uri`` for each ARC file of ``archives`` (path): rows (path, records).

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest rank (its ``X-Page-Id``; none: last),
    then date, file and offset, is response and the others revisit it.  Files of one name in several folders need calls of their own.
    """
    archives = one_task_each(archives.select("path"))
    records = materialize(archives.mapInArrow(_digested, _DIGESTS), "arc-records")
    work = archives.join(_revisits(records, least_bytes), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                archive, refers = _name(row["path"]), {x["offset"]: x for x in row["revisits"] or ()}
                name, n = re.sub(r"\.arc(\.gz)?$", "", archive) + ".warc.gz", 0
                with opened(row["path"]) as raw, written(uri, name) as out:
                    info = {"WARC-Record-ID": record_id(archive, -1, "", ""), "WARC-Date": iso_date(NO_DATE), "WARC-Filename": name,
                            "Content-Type": "application/warc-fields"}
                    out.write(_member(_record("warcinfo", info, f"software: queryforge\r\nisPartOf: {archive}\r\n".encode()), level))
                    for r in arc_records(raw):
                        out.write(_member(warc_record(archive, r, refers.get(r.offset)), level))
                        n += 1
                yield _manifest([(f"{uri}/{name}", n)])

    return materialize(one_task_each(materialize(work, "arc-work")).mapInArrow(run, _MANIFEST), "warc-files")


def warc_records(raw) -> Iterator[WarcRecord]:
    """Records of one WARC file, by their declared lengths; lines between records that begin none are skipped."""
    stream = _stream(raw)
    while line := _line(stream):
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := _line(stream)).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers.get("content-length", "")) if headers.get("content-length", "").isdigit() else 0
        block = _body(stream, length)
        yield WarcRecord(headers, block, len(block) == length)


_READ = "record_id string, record_type string, url string, date string, refers_id string, rank bigint, payload_bytes bigint, payload_digest string, valid boolean"


def read_warc(archives: DataFrame) -> DataFrame:
    """One row for each response, resource and revisit record of the WARC files in ``archives`` (path).

    ``payload_bytes`` is the length of the payload at hand (null in a revisit); ``valid`` says whether the digests in the header
    are those of what was read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            rows = []
            with opened(path) as raw:
                for h, block, whole in warc_records(raw):
                    kind = h.get("warc-type")
                    if kind in ("response", "resource", "revisit"):
                        head, payload = http_parts(block) or (b"", block)
                        told = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        here = kind != "revisit"
                        valid = whole and h.get("warc-block-digest") == f"sha1:{digest(block)}" and (not here or told == digest(payload))
                        rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), _rank(head),
                                     len(payload) if here else None, told, valid))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = (*[pa.string()] * 5, pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return one_task_each(archives.select("path")).mapInArrow(run, _READ)


def resolve(records: DataFrame) -> DataFrame:
    """Rows of ``read_warc`` with every revisit's ``payload_bytes`` and ``refers_rank`` taken from the record it refers to.

    A revisit whose record is not among the rows keeps nulls there.
    """
    records = materialize(records, "warc-records")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").withColumn("refers_id", F.coalesce("refers_id", F.lit("")))
    targets = records.where("record_type != 'revisit' and record_id is not null")
    facts = targets.select(F.col("record_id").alias("refers_id"), "payload_bytes", F.col("rank").alias("refers_rank"))
    wanted = materialize(facts.join(revisits.select("refers_id").distinct(), "refers_id", "left_semi").dropDuplicates(["refers_id"]), "warc-targets")
    found = join_facts(revisits, wanted, "refers_id")
    lost = (revisits.join(wanted, "refers_id", "left_anti")
            .withColumns({"payload_bytes": F.lit(None).cast("bigint"), "refers_rank": F.lit(None).cast("bigint")}))
    whole = records.where("record_type != 'revisit'").withColumn("refers_rank", F.lit(None).cast("bigint"))
    return whole.unionByName(found).unionByName(lost)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` written as ARC archives, converted into WARC archives and read back: a row for each page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, valid.  Null, empty and repeated values as in ``write_arc``;
    a page without id comes after all others as the response of its payload, and those that revisit it have no ``refers_to``.
    """
    spark = pages.sparkSession
    arcs = write_arc(pages, scratch_path(spark, "arc"))
    warcs = convert(arcs, scratch_path(spark, "warc"), least_bytes)
    return resolve(read_warc(warcs)).select(F.col("rank").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                            F.col("refers_rank").alias("refers_to"), "valid")
