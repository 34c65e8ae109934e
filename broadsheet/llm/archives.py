"""Legacy ARC archives read and converted to WARC.

An ARC file starts with a version block that says how many fields a record's header line has; each record is that line and
as many bytes as its last field declares. Version 1 lines are ``URL IP date type length``, version 2 lines have four more
fields. :func:`converted` parses them by their version and lengths and makes WARC records: an identifier derived from URI,
date and digest, the date in ISO form, the type, block and payload digests (SHA-1). Of records with equal payloads of
``REVISIT_BYTES`` or more, the one with the largest page id is the response and the others become revisits without
payload.

Files are written by Spark's text writer with the record's terminator as line separator, and read as whole binary files,
so they may lie in any store Spark reaches; they are packed with gzip. ARC files may also be plain, or hold a gzip member
per record, and blocks may be any bytes. A file holds about ``FILE_BYTES`` bytes (or one longer page).

Null html gives an empty payload; null or empty URLs become ``urn:none``, blanks and control characters in URLs are
percent-coded. Rows that repeat are records of their own (revisits of one another when long enough, except that equal
largest page ids are all responses). A row without page_id cannot be referred to. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Collection, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import work_path

from .common import stored, table
from .registry import query

REVISIT_BYTES = 1000
FILE_BYTES = 16 << 20
ROWS = 64
#: Header lines and field names of the two formats.
ARC_FIELDS = {"1": "URL IP-address Archive-date Content-type Archive-length",
              "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = "\r\n\r\n"
_VERSION = re.compile(rb"\d+ \d+ [^\n]*\nURL[- ]")
_BLANK = re.compile(r"[\x00-\x20\x7f]")
_DATE = "20240101000000"


def arc_lines(rows: Iterator[tuple[int | None, str | None, str | None]], name: str, version: str) -> Iterator[str]:
    """Version block and records of one archive, without the line end after each."""
    about = f"{version} 0 broadsheet\n{ARC_FIELDS[version]}\n"
    more = " 200 - - 0 " + name if version == "2" else ""
    yield f"filedesc://{name} 0.0.0.0 {_DATE} text/plain{more} {len(about)}\n{about}"
    for page, url, html in rows:
        url = _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        block = head + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n" + (html or "")
        yield f"{url} 0.0.0.0 {_DATE} text/html{more} {len(block.encode())}\n{block}"


def write_arcs(pages: DataFrame, path: str) -> None:
    """``pages (page_id, url, html)`` as ARC files, version 1 and 2 by turns."""
    size = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 300)).first()[0] or 0
    dealt = pages.select("page_id", "url", "html").repartition(max(1, -(-size // FILE_BYTES)))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{uuid.uuid4().hex}.arc"
        rows = ((r["page_id"], r["url"], r["html"]) for b in batches for i in range(0, b.num_rows, 64)
                for r in b.slice(i, 64).to_pylist())
        lines = arc_lines(rows, name, "12"[int(name[0], 16) % 2])
        while some := list(islice(lines, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])

    dealt.mapInArrow(lines, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def unpacked(data: bytes) -> tuple[bytes, set[int]]:
    """Content of a file, packed with gzip or not, and where its members start in it."""
    if not data.startswith(b"\x1f\x8b"):
        return data, {0}
    at, size, parts, starts = 0, 0, [], set()
    while at < len(data):
        starts.add(size)
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("a gzip member ends too early")
            parts.append(member.decompress(data[at:at + 65536]))
            size += len(parts[-1])
            at += 65536
        at = min(at, len(data)) - len(member.unused_data)
        while data[at:at + 1] == b"\0":
            at += 1
    return b"".join(parts), starts


def _text(data: bytes) -> str:
    """UTF-8 text; bytes that are none are percent-coded."""
    return re.sub("[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", data.decode("utf-8", "surrogateescape"))


def parse_arc(data: bytes, starts: Collection[int] = (0,)) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record after the version block, which stands where a file or a gzip member starts."""
    at, fresh, fields = 0, False, ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"]
    while at < len(data):
        fresh = fresh or at in starts
        end = data.index(b"\n", at)
        line = _text(data[at:end]).removesuffix("\r")
        if not line:
            at = end + 1
            continue
        parts = line.split(" ")
        size = int(parts[-1])
        block = data[end + 1:end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record {parts[0]} declares {size} bytes, {len(block)} are left")
        at = end + 1 + size
        if fresh and line.startswith("filedesc://") and parts[3:4] == ["text/plain"] and _VERSION.match(block):
            fields = _text(block).split("\n")[1].strip().split(" ")
        elif len(parts) == len(fields):
            yield dict(zip(fields, parts, strict=True)), block
        else:
            raise ValueError(f"header line has {len(parts)} fields, the version block names {len(fields)}")
        fresh = False


def split_http(block: bytes) -> tuple[bytes, bytes, int | None]:
    """HTTP header, payload, page id of a captured response; a block that is no HTTP response is payload in full."""
    if not block.startswith(b"HTTP/"):
        return b"", block, None
    end = re.search(rb"\r?\n\r?\n", block)
    cut = end.end() if end else len(block)
    found = re.search(rb"\r?\nX-Page-Id: (-?\d+)(?:\r?\n|$)", block[:cut])
    return block[:cut], block[cut:], int(found[1]) if found else None


def iso_date(date: str) -> str:
    """WARC form of an ARC date of 8 to 14 digits; what is missing is zero."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


PARSED = "page_id bigint, uri string, date string, mime string, digest string, payload_bytes bigint, block binary"


def arc_records(spark, path: str) -> DataFrame:
    """Records of all ARC files below a path."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                records = parse_arc(*unpacked(content.as_py()))
                while some := list(islice(records, ROWS)):
                    rows = []
                    for fields, block in some:
                        _, payload, page = split_http(block)
                        rows.append({"page_id": page, "uri": fields["URL"], "date": fields["Archive-date"],
                                     "mime": fields["Content-type"], "digest": hashlib.sha1(payload).hexdigest(),
                                     "payload_bytes": len(payload), "block": block})
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("page_id", pa.int64()), *((x, pa.string()) for x in ("uri", "date", "mime", "digest")),
                      ("payload_bytes", pa.int64()), ("block", pa.binary())])
    return _files(spark, path).mapInArrow(parse, PARSED)


def record_id(uri: str, date: str, digest: str, page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {digest} {page}')}>"


def b32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(row: dict) -> bytes:
    """One WARC record without its terminator. A revisit keeps the HTTP header and names the response it repeats."""
    block = row["block"]
    head, _, _ = split_http(block)
    http = bool(head)
    lines = ["WARC/1.0", f"WARC-Type: {'response' if http else 'resource'}",
             f"WARC-Record-ID: {record_id(row['uri'], row['date'], row['digest'], row['page_id'])}",
             f"WARC-Date: {iso_date(row['date'])}", f"WARC-Target-URI: {row['uri']}",
             f"Content-Type: {'application/http; msgtype=response' if http else row['mime']}",
             f"WARC-Payload-Digest: {b32(row['digest'])}", f"X-Payload-Length: {row['payload_bytes']}",
             f"WARC-Identified-Payload-Type: {row['mime']}"]
    if row["refers_page"] is not None:
        lines[1] = "WARC-Type: revisit"
        block = head
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {row['refers_uri']}",
                  f"WARC-Refers-To-Date: {iso_date(row['refers_date'])}",
                  f"WARC-Refers-To: {record_id(row['refers_uri'], row['refers_date'], row['digest'], row['refers_page'])}"]
    lines += [f"WARC-Block-Digest: {b32(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def converted(records: DataFrame) -> DataFrame:
    """``(value)``: WARC records of parsed ARC records. Which payloads repeat is settled on digests alone."""
    long = f"payload_bytes >= {REVISIT_BYTES}"
    keys = records.where(long).groupBy("digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "uri", "date")).alias("first"), F.count("*").alias("c")).where("c > 1 and first.page_id is not null")
    keys = stored(keys.select("digest", "payload_bytes", "first"), "repeated")
    joined = records.join(keys, ["digest", "payload_bytes"], "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    rows = joined.select("page_id", "uri", "date", "mime", "digest", "payload_bytes", "block",
                         F.when(other, F.col("first.page_id")).alias("refers_page"),
                         F.when(other, F.col("first.uri")).alias("refers_uri"),
                         F.when(other, F.col("first.date")).alias("refers_date"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([warc_record(r) for r in batch.slice(i, 64).to_pylist()], pa.binary())], names=["value"])

    # The text writer writes the bytes of a string as they are, UTF-8 or not.
    return rows.mapInArrow(build, "value binary").select(F.col("value").cast("string"))


def write_warcs(records: DataFrame, path: str) -> None:
    converted(records).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in head[1:])
        size = int(fields["Content-Length"])
        if not head[0].startswith("WARC/") or data[end + 4 + size:end + 8 + size] != END.encode():
            raise ValueError(f"broken record at byte {at}")
        yield fields, data[end + 4:end + 4 + size]
        at = end + 8 + size


def warc_records(spark, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_id, date, uri)`` of all WARC files
    below a path. Block and payload digests are checked against the content; ``refers_to`` is the page of the record that
    a revisit's ``WARC-Refers-To`` names, and null where no such record is there."""
    kind = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("record_id", pa.string()), ("refers_id", pa.string()),
                      ("date", pa.string()), ("uri", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(gzip.decompress(content.as_py())):
                    _, payload, page = split_http(block)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if b32(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"] or (
                            fields["WARC-Type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not fit")
                    rows.append({"page_id": page, "payload_bytes": int(fields["X-Payload-Length"]),
                                 "payload_digest": digest, "record_type": fields["WARC-Type"],
                                 "record_id": fields["WARC-Record-ID"], "refers_id": fields.get("WARC-Refers-To"),
                                 "date": fields["WARC-Date"], "uri": fields["WARC-Target-URI"]})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    records = stored(_files(spark, path).mapInArrow(
        parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, record_id string, "
               "refers_id string, date string, uri string"), "records")
    # Only records that are named are looked up, and each once; revisits without a name do not share a key.
    named = records.where("refers_id is not null").select(F.col("refers_id").alias("target")).distinct()
    targets = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("target"), "page_id").join(
        named, "target", "left_semi").groupBy("target").agg(F.min("page_id").alias("refers_to"))
    revisits = records.where("refers_id is not null").join(targets, F.col("refers_id") == F.col("target"), "left").drop("target")
    return records.where("refers_id is null").withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back."""
    spark = pages.sparkSession
    arcs, warcs = work_path(spark, "arc"), work_path(spark, "warc")
    write_arcs(pages, arcs)
    write_warcs(arc_records(spark, arcs), warcs)
    return warc_records(spark, warcs)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, strlen(html) AS n FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""


@query("op8_warc", SQL)
def op8_warc(spark, sf_dir):
    """Every page as legacy archive record, converted and read back from the converted archives."""
    return archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
