"""Legacy web archives: ARC files (versions 1 and 2) to WARC, and both ways to rows.

An ARC file begins with a version block, whose first line is a record line of
its own and whose text names the version and the fields of all record lines.
Each record is one line, whose last field declares how many bytes of document
follow, those bytes, and a line feed. Version 1 lines have five fields,
version 2 lines ten. The document of an HTTP record is the response: status line,
headers, an empty line, the payload.

``convert`` reads ARC files and writes the WARC/1.1 equivalents: record ids are
derived from file name and offset (a repeated task writes the same ids), dates
become ISO 8601, the type follows from duplicate payloads, and block and payload
digests are computed. Files are written by Spark's text sink, one row per
file and the sink's separator as the records' last line ends, gzip over the
file; so writes are committed as a whole and work on any file system.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import new_folder

FILE_BYTES = 16_000_000
LEAST_REVISIT = 1000
UNDATED = "19960101000000"

# Fixed values of the formats: field lists of the record lines, and line ends.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_KEY = b"X-Record-Key"
_FROM = "X-Refers-To-Key"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _line_safe(url: str | None) -> str:
    """A URL as one field: white space and controls percent-encoded; none: ``-``."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def _http(payload: bytes, key: str | None) -> bytes:
    lines = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    if key is not None:
        lines.append(_KEY + b": " + key.encode())
    return CRLF.join(lines) + CRLF + CRLF


def arc_record(version: int, url: str | None, date: str, key: str | None, payload: bytes, at: int, name: str) -> bytes:
    document = _http(payload, key) + payload
    fields = [_line_safe(url), "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(document).hexdigest(), "-", str(at), name]
    return " ".join([*fields, str(len(document))]).encode() + b"\n" + document + b"\n"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    text = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(text) + 1)]).encode() + b"\n" + text + b"\n" + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, named fields and document of each record; the version block says how lines are read. No bytes: none."""
    if not data:
        return
    head = data.index(b"\n") + 1
    size = int(data[:head].rsplit(b" ", 1)[1])
    version_line, names = data[head : head + size].split(b"\n", 2)[:2]
    version, fields = int(version_line.split(b" ")[0]), names.decode().split(" ")
    if ARC_FIELDS.get(version) != tuple(fields):
        raise ValueError(f"unknown ARC version {version_line!r}")
    at = head + size + 1
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # spare line ends between records
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode().rstrip("\r").rsplit(" ", len(fields) - 1)  # a sloppy URL may hold spaces
        found = dict(zip(fields, values, strict=True))
        length = int(found["Archive-length"])
        document = data[end + 1 : end + 1 + length]
        if len(document) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(document)} are there")
        yield at, found, document
        at = end + 1 + length + 1


def iso_date(date: str) -> str:
    """ARC dates (14 digits, or fewer: filled up) as WARC dates."""
    d = date + UNDATED[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(source: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{offset}')}>"


def split_http(document: bytes) -> tuple[bytes, bytes]:
    """Headers with the empty line, and payload; documents without headers are payload alone."""
    cut = document.find(CRLF + CRLF)
    if not document.startswith(b"HTTP/") or cut < 0:
        return b"", document
    return document[: cut + 4], document[cut + 4 :]


def http_field(headers: bytes, name: bytes) -> str | None:
    for line in headers.split(CRLF):
        key, _, value = line.partition(b": ")
        if key == name:
            return value.decode()
    return None


def _sha1(data: bytes) -> str:
    import base64

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """Header and block, without the two line ends that close a record."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        cut = data.index(CRLF + CRLF, at)
        lines = data[at:cut].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = data[cut + 4 : cut + 4 + size]
        if len(block) != size or data[cut + 4 + size : cut + 8 + size] != CRLF + CRLF:
            raise ValueError(f"record at {at} declares {size} bytes and does not end there")
        yield fields, block
        at = cut + 8 + size


def inflate(content: bytes) -> bytes:
    """The bytes of a file; gzip members, one or many, are opened."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _write_files(files: DataFrame, folder: str, line_end: str) -> None:
    """A file for each row of ``files(content binary)``."""
    files.select(F.col("content").cast("string")).write.option("lineSep", line_end).option("maxRecordsPerFile", 1).option(
        "compression", "gzip"
    ).option("zlib.compress.level", "THREE").text(folder)


def _arcs(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for key, url, date, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = number % 2 + 1  # files of both versions
                name = f"part-{part:05d}-{number:05d}.arc"
                if not held:
                    held.append(arc_version_block(version, name, UNDATED))
                    size = len(held[0])
                held.append(arc_record(version, url, date or UNDATED, key, payload or b"", size, name))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.record_batch([pa.array([b"".join(held)[:-1]])], ["content"])
                    number, held = number + 1, []
        if held:
            yield pa.record_batch([pa.array([b"".join(held)[:-1]])], ["content"])

    return run


def write_arc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """``records(key string, url string, date string, payload binary)`` to ARC files of about ``file_bytes``.

    Null payloads are empty; null dates are UNDATED; null or empty URLs are ``-``; a
    null key has no header. A record is never split, however long.
    """
    _write_files(records.select("key", "url", "date", "payload").mapInArrow(_arcs(file_bytes), "content binary"), folder, "\n")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows: list[tuple] = []
            size, source = 0, path.rsplit("/", 1)[-1]
            for at, fields, document in parse_arc(inflate(content.as_py())):
                headers, payload = split_http(document)
                url = fields["URL"]
                rows.append((record_id(source, at), http_field(headers, _KEY), None if url == "-" else url, iso_date(fields["Archive-date"]), hashlib.sha1(payload).hexdigest(), len(payload), document))
                size += len(document)
                if size > 4_000_000:
                    yield _record_rows(rows)
                    rows, size = [], 0
            if rows:
                yield _record_rows(rows)


_RECORD = "record_id string, key string, url string, date string, digest string, payload_bytes long, document binary"


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of ARC files: record_id, key, url, date, digest (hex SHA-1 of the payload), payload_bytes, document."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_read, _RECORD)


def _warcs(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_warc_of(*row))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.record_batch([pa.array([(CRLF + CRLF).join(held)])], ["content"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([(CRLF + CRLF).join(held)])], ["content"])

    return run


def _warc_of(own: str, url: str | None, date: str, document: bytes, first_id: str | None, first_key: str | None) -> bytes:
    headers, payload = split_http(document)
    again = first_id is not None
    block = headers if again else document
    return warc_record(
        [
            ("WARC-Type", "revisit" if again else "response"),
            ("WARC-Record-ID", own),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Profile", REVISIT_PROFILE if again else None),
            ("WARC-Refers-To", first_id),
            (_FROM, first_key if again else None),
            ("WARC-Block-Digest", _sha1(block)),
            ("WARC-Payload-Digest", _sha1(payload)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_revisit: int = LEAST_REVISIT,
            file_bytes: int = FILE_BYTES) -> None:
    """ARC files to WARC files.

    Of records with equal payloads of at least ``least_revisit`` bytes the one
    with the largest key (as a number; then by record id) is the response, the
    others revisit it and hold only their HTTP headers. Payload digests meet
    without the payloads; only which records revisit goes back to them.
    """
    records = read_arc(spark, arc_folder)
    marks = records.filter(F.col("payload_bytes") >= least_revisit).select("record_id", "key", "digest", "payload_bytes")
    best = F.max(F.struct(F.expr("try_cast(key as bigint)").alias("n"), "record_id", "key"))
    firsts = marks.groupBy("digest", "payload_bytes").agg(best.alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    again = (
        marks.join(firsts, ["digest", "payload_bytes"])
        .filter(F.col("record_id") != F.col("first.record_id"))
        .select("record_id", F.col("first.record_id").alias("first_id"), F.col("first.key").alias("first_key"))
    )
    whole = records.select("record_id", "url", "date", "document").join(again, "record_id", "left")
    _write_files(
        whole.select("record_id", "url", "date", "document", "first_id", "first_key").mapInArrow(_warcs(file_bytes), "content binary"),
        warc_folder,
        "\r\n\r\n",
    )


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import base64

    for batch in batches:
        for content in batch["content"]:
            rows = []
            for fields, block in parse_warc(inflate(content.as_py())):
                headers, payload = split_http(block)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                again = fields["WARC-Type"] == "revisit"
                if not again and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not hold")
                size = int(http_field(headers, b"Content-Length")) if again else len(payload)
                rows.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), fields["WARC-Date"], http_field(headers, _KEY), size, digest, fields.get("WARC-Refers-To"), fields.get(_FROM), None if again else payload))
            if not rows:
                continue
            names = [x.split(" ")[0] for x in _WARC.split(", ")]
            kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_WARC = (
    "record_type string, record_id string, url string, date string, key string, payload_bytes long, "
    "payload_digest string, refers_to_id string, refers_to_key string, payload binary"
)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC files; payload is null for revisits, digests of responses are checked."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_read_warc, _WARC)


def round_trip(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``records`` written as ARC in the shared folder, converted to WARC there, and read back."""
    spark = records.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(records, arc, file_bytes)
    convert(spark, arc, warc, file_bytes=file_bytes)
    return read_warc(spark, warc)
