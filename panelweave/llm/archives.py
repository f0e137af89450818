"""Legacy web archives: ARC files are parsed and rewritten as WARC files.

An ARC record is one header line, the declared number of bytes, and a line feed. Version 1 lines hold URL, IP
address, date, content type and length; version 2 adds result code, checksum, location, offset and file name
before the length. The first record (`filedesc://`) names the version. The bytes of a web record are an HTTP
message.

The converter reads headers and lengths, never searches for record borders, and synthesises what WARC needs: a
record id from the record's content and place, an ISO timestamp from the 14 digits, the type from the URL and from
equal payloads, block and payload digests as base32 SHA-1. Of records with equal payloads of at least `least`
bytes, the one with the largest page id is the response and the others revisit it; smaller ones are responses.

Files are written and read by Spark alone, so any file system it knows serves. A file holds at most
`RECORDS_PER_FILE` records, since a file is read by one task, and is compressed as a whole, at gzip's fastest level:
the usual one costs about four times the CPU time for files a ninth smaller.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.membership import filter_bits, filter_words, with_membership
from panelweave.llm.storage import scratch_path, written
from panelweave.operators.skew import attach_groups

RECORDS_PER_FILE = 1000
ID_HEADER = "X-Page-Id"
# Marks the payload of a record whose bytes aren't UTF-8 text, since files are written as text.
ENCODING_HEADER = "X-Payload-Encoding"
# Fixed values of the two ARC versions: the field line of each.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_SCHEMA = "url string, ip string, date string, content_type string, message binary, file string, place long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _save(frame: DataFrame, path: str, separator: str) -> None:
    """One text value per record; `separator` ends each, as the format asks."""
    options = {"lineSep": separator, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": RECORDS_PER_FILE}
    frame.write.options(**options).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _unpacked(data: bytes) -> bytes:
    """All members of a gzip file, or the data itself if it isn't compressed."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out) + data if not out else b"".join(out)


def write_arc(pages: DataFrame, path: str, version: Column, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as ARC records of the given version (1 or 2); each file is led by no version record of its own.

    The HTTP header keeps the page id and the payload's length. White space in URLs is percent-encoded, as is the
    colon of `filedesc://`, which only file descriptions begin with; a null URL is written as `-`, a null page as an
    empty payload.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    ident = F.when(F.col(page_id).isNotNull(), F.concat(F.lit(f"{ID_HEADER}: "), F.col(page_id).cast("string"), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        ident,
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    plain = F.regexp_replace(F.regexp_replace(F.col(url), r"[\x00-\x20\x7F]", "%20"), "^filedesc://", "filedesc%3A//")
    address = F.coalesce(F.nullif(plain, F.lit("")), F.lit("-"))
    size = (F.octet_length(head) + F.octet_length(body)).cast("string")
    extra = F.when(version == 2, F.lit(" 200 - - 0 pages.arc.gz")).otherwise("")
    line = F.concat(address, F.lit(" 0.0.0.0 20200101000000 text/html"), extra, F.lit(" "), size, F.lit("\n"))
    _save(pages.select(F.concat(line, head, body).alias("value")), path, "\n")


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, str, bytes]]:
    """(url, ip, date, content type, bytes) of each record; file descriptions are left out.

    The version of a line is told by its fields: the last is always the length, and version 2 has ten. A record
    cut short at the end of the file ends the reading with an error.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").strip("\r")
        if not line:
            at = end + 1 if end >= 0 else len(data)
            continue
        fields = line.split(" ")
        # From the right: a version 2 line has nine fields after the URL, a version 1 line four.
        after = 9 if len(fields) >= 10 and re.fullmatch(r"\d{14}", fields[-8]) else 4
        if len(fields) <= after or not fields[-1].isdigit():
            raise ValueError(f"no ARC record header at byte {at}: {line[:80]!r}")
        url, size, start = " ".join(fields[:-after]), int(fields[-1]), end + 1
        if start + size > len(data):
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, {len(data) - start} are left")
        if not url.startswith("filedesc://"):
            yield url, fields[-after], fields[1 - after], fields[2 - after], data[start : start + size]
        at = start + size


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below `path`, with their file and place in it."""
    return _map_records(spark, path, lambda *record: record, RECORD_SCHEMA, RECORD_TYPES)


RECORD_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]


def _map_records(spark: SparkSession, path: str, row: Callable[..., tuple], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """A row for each record of all ARC files below `path`: `row` of the record's fields, file and place."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name, rows, size = file.as_py().rpartition("/")[2], [], 0
                for place, record in enumerate(parse_arc(_unpacked(content.as_py()))):
                    rows.append(row(*record, name, place))
                    size += len(record[4])
                    if size > 1 << 23:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
                yield _batch(rows, names, kinds)

    return _files(spark, path).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _split_message(message: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    head, blank, payload = message.partition(b"\r\n\r\n")
    return (head + blank, payload) if blank else (b"", message)


def _header(message_head: str, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", message_head)
    return found[1] if found else None


def _as_text(payload: bytes) -> tuple[str, bool]:
    """The payload as text; bytes that aren't UTF-8 as base64, and True."""
    try:
        return payload.decode(), False
    except UnicodeDecodeError:
        return base64.b64encode(payload).decode(), True


BRIEF = "page_id long, url string, payload_bytes long, digest string, record_id string"
_BRIEF_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
DESCRIBED = f"{BRIEF}, date string, head string, payload string, encoded boolean"
_DESCRIBED_TYPES = [*_BRIEF_TYPES, *[pa.string()] * 3, pa.bool_()]


def _brief(url: str, _ip: str, date: str, _kind: str, message: bytes, file: str, place: int) -> tuple:
    return _row(url, date, *_split_message(message), file, place)


def _described(url: str, _ip: str, date: str, _kind: str, message: bytes, file: str, place: int) -> tuple:
    head, payload = _split_message(message)
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    return (*_row(url, date, head, payload, file, place), stamp, head.decode("utf-8", "replace"), *_as_text(payload))


def _row(url: str, date: str, head: bytes, payload: bytes, file: str, place: int) -> tuple:
    ident = _header(head.decode("utf-8", "replace"), ID_HEADER)
    digest = payload_digest(payload)
    record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest} {file} {place}")
    return int(ident) if ident else None, url, len(payload), digest, f"<urn:uuid:{record_id}>"


def describe(records: DataFrame) -> DataFrame:
    """ARC records with the parts of a WARC record: timestamp, header and payload, digest, record id."""
    names = [x.split()[0] for x in DESCRIBED.split(", ")]
    fields = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_described(*(r[f] for f in fields)) for r in batch.to_pylist()], names, _DESCRIBED_TYPES)

    return records.mapInArrow(run, DESCRIBED)


def read_described(spark: SparkSession, path: str) -> DataFrame:
    """`describe` of `read_arc`, with each record passed through Python once."""
    return _map_records(spark, path, _described, DESCRIBED, _DESCRIBED_TYPES)


def read_brief(spark: SparkSession, path: str) -> DataFrame:
    """The columns of `read_described` that tell equal payloads; no payload leaves the task's Python."""
    return _map_records(spark, path, _brief, BRIEF, _BRIEF_TYPES)


def write_warc(described: DataFrame, path: str, least: int = 0, brief: DataFrame | None = None) -> None:
    """WARC files: a response for the largest page id of each digest, revisits for the others.

    A filter of bounded size tells which digests may be repeated; all other records are written where they
    were read, without a shuffle. `brief` has the same records without payloads, if they can be had at less cost.
    """
    named = described.withColumn("hash", F.xxhash64("digest"))
    digests = (described if brief is None else brief).where(F.col("payload_bytes") >= least)
    narrow = written(digests.select("page_id", "record_id", "url", "digest", F.xxhash64("digest").alias("hash"), "payload_bytes"), "digests")
    bits = filter_bits(narrow.count())
    words = written(filter_words(narrow, "hash", bits, at_least=2), "repeated")
    tested = with_membership(named, "hash", words, bits, "repeated")
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id", "url")).alias("first")
    possible = with_membership(narrow, "hash", words, bits, "repeated").where("repeated")
    heads = possible.groupBy("digest").agg(first).select("digest", F.col("first.record_id").alias("head_id"), F.col("first.url").alias("head_url"))
    linked = attach_groups(tested.where("repeated"), heads, ["digest"])
    own = tested.where(~F.col("repeated")).withColumns({"head_id": F.col("record_id"), "head_url": F.col("url")})
    rows = linked.unionByName(own)
    revisit = (F.col("payload_bytes") >= least) & (F.col("record_id") != F.col("head_id"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(
        line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("head_id")), line("WARC-Refers-To-Target-URI", F.col("head_url"))
    )
    value = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, refers).otherwise(""),
        F.when(F.col("encoded") & ~revisit, F.lit(f"{ENCODING_HEADER}: base64\r\n")).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    _save(rows.select(value.alias("value")), path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        blank = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or blank < 0:
            raise ValueError(f"no WARC record header at byte {at}")
        lines = data[at:blank].decode("utf-8").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        start, size = blank + 4, int(headers["Content-Length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} doesn't end after {size} bytes")
        yield headers, data[start : start + size]
        at = start + size + 4


READ = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"
_READ_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Digests of responses are computed again and must equal the declared ones.

    The length and digest of a revisit are those of the payload it stands for, from its headers.
    """
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse_warc(_unpacked(content.as_py())):
                    head, payload = _split_message(block)
                    text = head.decode("utf-8", "replace")
                    declared, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if ENCODING_HEADER in headers:
                        payload = base64.b64decode(payload)
                    if kind == "response" and payload_digest(payload) != declared:
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
                    size = len(payload) if kind == "response" else int(_header(text, "Content-Length") or 0)
                    ident = _header(text, ID_HEADER)
                    rows.append((int(ident) if ident else None, headers["WARC-Target-URI"], headers["WARC-Date"], headers["WARC-Record-ID"],
                                 kind, size, declared, headers.get("WARC-Refers-To")))
                yield _batch(rows, names, _READ_TYPES)

    return _files(spark, path).mapInArrow(run, READ)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Rewrite all ARC files below `arc_path` as WARC files."""
    write_warc(read_described(spark, arc_path), warc_path, least, read_brief(spark, arc_path))


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages through ARC files of both versions and WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, F.when(F.coalesce(F.col("page_id"), F.lit(0)) % 2 == 0, 1).otherwise(2))
    convert(spark, arc, warc, least)
    records = written(read_warc(spark, warc), "records")
    revisits, responses = records.where("refers_to_id IS NOT NULL"), records.where("refers_to_id IS NULL")
    named = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    linked = attach_groups(revisits, named, ["refers_to_id"])
    return linked.select(*columns).unionByName(responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns))
