"""A converter of legacy ARC archives to WARC.

ARC 1 records begin with ``URL IP date type length``, ARC 2 records with ``URL
IP date type result checksum location offset filename length``; a version block
(``filedesc://``) says which, and without one the number of fields does. Each is
followed by so many bytes as it declares. The converter parses these and makes equivalent WARC records: an
identifier that depends on the record alone, an ISO timestamp, a type and the
SHA-256 digest of the payload. A version block becomes a ``warcinfo`` record, an
HTTP capture a ``response`` or a ``revisit``, and anything else (``dns:`` lookups,
FTP files) a ``resource`` of its declared content type.

Archives are gzip files, written and committed by Spark's own writer: each row
of the writer is a whole record, and its line separator is what ends a record.
They are read by Spark's text reader in lines and put together again in the task,
so a task holds a batch of lines and one record, however large the file.

Defined results: a null or empty body is a record with an empty payload; a null
URL becomes ``urn:page:<id>``, and blanks in one are escaped by the writer; a
header is read from both ends, so that blanks in a foreign URL stay in it; a
header with other fields but a URL first and a length last keeps its record,
with what is missing as ``-``; other lines between records are skipped; a date
that is not a number of 8 to 14 digits becomes the epoch; a record that is cut
off is kept and marked ``WARC-Truncated``; of pages with equal payloads of
MIN_PAYLOAD bytes or more that with the smallest id is the response, and where
that id is repeated all of its records are; records without an id are no revisits;
an empty table gives empty archives; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.session import ship_package
from tesselith.staging import shared_folder, stage

MIN_PAYLOAD = 100
#: Records of one file. Files are read in streams, so their size matters to the number of tasks alone.
FILE_RECORDS = 1 << 14

# Fixed values of the two formats.
ARC_1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
ARC_2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
ARC_END = "\n"
WARC_VERSION = "WARC/1.1"
WARC_END = "\r\n\r\n"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def octets(text: Column) -> Column:
    return F.octet_length(text)


def http_head(page_id: Column, body: Column) -> Column:
    """The HTTP lines of a capture; the id of its row goes along in one of them."""
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        octets(body).cast("string"),
        F.lit("\r\n\r\n"),
    )


def _write(records: DataFrame, path: str, end: str) -> None:
    """One archive record, ``record``, a row."""
    records.select(F.col("record").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def version_block(version: int) -> Column:
    """What an ARC file begins with."""
    fields = ARC_1_FIELDS if version == 1 else ARC_2_FIELDS
    block = f"{version} 0 tesselith\n{fields}\n"
    between = "" if version == 1 else " 200 - - 0 pages.arc"
    return F.lit(f"filedesc://pages.arc 0.0.0.0 20010909014640 text/plain{between} {len(block)}\n{block}\n")


def write_arc(pages: DataFrame, path: str, version: int = 2) -> None:
    """An ARC archive of (page_id, url, html)."""
    body = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"\s", "%20")
    block = F.concat(http_head(F.col("page_id"), body), body)
    date = F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 28))), "yyyyMMddHHmmss")
    length = octets(block).cast("string")
    if version == 1:
        fields = [url, F.lit("0.0.0.0"), date, F.lit("text/html"), length]
    else:
        fields = [url, F.lit("0.0.0.0"), date, F.lit("text/html"), F.lit("200"), F.md5(body), F.lit("-"), F.lit("0"), F.lit("pages.arc"), length]
    # A task's rows are numbered from 0 in the low bits, and it begins a file after each FILE_RECORDS rows.
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit(FILE_RECORDS - 1)) == 0
    head = F.when(begins, version_block(version)).otherwise(F.lit(""))
    _write(pages.select(F.concat(head, F.concat_ws(" ", *fields), F.lit("\n"), block).alias("record")), path, ARC_END)


class Stream:
    """The bytes of a file, given in chunks, read in lines and counts."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.buffer = chunks, bytearray()

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.buffer += chunk
        return True

    def line(self) -> bytes | None:
        start = 0
        while (at := self.buffer.find(b"\n", start)) < 0:
            start = len(self.buffer)
            if not self.more():
                return None
        out = bytes(self.buffer[: at + 1])
        del self.buffer[: at + 1]
        return out

    def take(self, n: int) -> bytes:
        """So many bytes, or what is left."""
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """The HTTP lines of a block, its payload, and the lines by lower-case name."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    end = re.search(rb"\r?\n\r?\n", block)
    at = end.end() if end else len(block)
    fields = dict(line.split(": ", 1) for line in block[:at].decode("utf-8", "replace").splitlines()[1:] if ": " in line)
    return block[:at], block[at:], {k.lower(): v for k, v in fields.items()}


# Each field but the URL, which comes first, and the content type is free of blanks, so both may have some.
_ARC_HEADS = {
    10: re.compile(r"(\S.*) (\S+) (\d{1,14}|-) (\S.*?) (\d{1,3}|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)"),
    5: re.compile(r"(\S.*) (\S+) (\d{1,14}|-) (\S.*?) (\d+)"),
}


def arc_header(head: str, fields: int) -> list[str] | None:
    """URL, IP, date, content type and length of a header line. ``fields``: how many the version block named, or 0."""
    for count in (fields,) if fields else (10, 5):
        if found := _ARC_HEADS[count].fullmatch(head):
            return [*found.group(1, 2, 3, 4), found[count]]
    parts = head.split()
    if len(parts) > 1 and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", parts[0]) and parts[-1].isdigit():
        return [parts[0], "-", next((p for p in parts[1:-1] if re.fullmatch(r"\d{8,14}", p)), "-"), "-", parts[-1]]
    return None


def parse_arc(stream: Stream) -> Iterator[tuple[list[str], bytes]]:
    """(URL, IP, date, content type and length; block) of each record of either version, version blocks too."""
    fields = 0
    while (line := stream.line()) is not None:
        head = line.decode("utf-8", "replace").rstrip("\r\n")
        is_version = head.startswith("filedesc://")
        parts = arc_header(head, 0 if is_version else fields)
        if parts is None:
            continue
        block = stream.take(int(parts[-1]))
        if is_version:
            fields = 10 if block.startswith(b"2 ") else 5
        yield parts, block


def parse_warc(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by lower-case name, block) of each record."""
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        header: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.strip().lower()] = value.strip()
        yield header, stream.take(int(header.get("content-length", "0")))


def _timestamp(digits: str) -> str:
    """WARC's timestamp of ARC's 14 digits; missing ones are those of the earliest such time."""
    if not (digits.isdigit() and 8 <= len(digits) <= 14):
        return "1970-01-01T00:00:00Z"
    d = digits + "00000000000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes."""
    held, bytes_ = [], 0
    for row in rows:
        held.append(row)
        bytes_ += size(row)
        if len(held) >= 2000 or bytes_ >= 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, bytes_ = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


ARC_ROWS = "url string, ip string, timestamp string, type string, content_type string, page_id bigint, http binary, payload binary, payload_bytes bigint, payload_digest string, record_id string, cut boolean"
_ARC_SCHEMA = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in ARC_ROWS.split(", "))])


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[Stream]:
    """The files of a task's lines (file, line), one after another; whatever of one isn't read is passed over."""
    held: list[tuple[int, bytes]] = []

    def pieces() -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            files = batch.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield int(files[low]), b"\n".join(batch.column("line").slice(low, high - low).to_pylist()) + b"\n"

    source = pieces()

    def chunks(file: int) -> Iterator[bytes]:
        while held or (piece := next(source, None)) is not None:
            if held:
                piece = held.pop()
            if piece[0] != file:
                held.append(piece)
                return
            yield piece[1]

    while held or (piece := next(source, None)) is not None:
        if not held:
            held.append(piece)
        own = chunks(held[-1][0])
        yield Stream(own)
        for _ in own:
            pass


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for stream in _files(batches):
            for (url, ip, date, kind, length), block in parse_arc(stream):
                http, payload, fields = _http(block)
                is_version = url.startswith("filedesc://")
                type_ = "warcinfo" if is_version else "response" if http else "resource"
                kind = "application/http; msgtype=response" if http else "application/octet-stream" if kind == "-" else kind
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {fields.get('x-page-id', '')} {hashlib.sha256(block).hexdigest()}")
                yield url, ip, _timestamp(date), type_, kind, _number(fields.get("x-page-id")), http, payload, len(payload), hashlib.sha256(payload).hexdigest(), f"<urn:uuid:{name}>", len(block) < int(length)

    yield from _batches(rows(), _ARC_SCHEMA, lambda r: len(r[7]))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the archive's files, in order within each, for these can't be split."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC_ROWS of all records in an ARC archive of either version."""
    ship_package(spark)
    return read_files(spark, path).mapInArrow(_read_arc, ARC_ROWS)


def convert(records: DataFrame, key: str = "page_id") -> DataFrame:
    """WARC records, as ``record``, of ARC_ROWS. A payload of MIN_PAYLOAD bytes or more that a smaller id has makes a revisit of it."""
    records = stage(records, "parsed")
    large = records.where((F.col("payload_bytes") >= MIN_PAYLOAD) & (F.col("type") == "response") & F.col(key).isNotNull())
    # Counted in each task first, so a payload that very many pages have sends one row a task.
    first = large.groupBy("payload_digest").agg(F.min(F.struct(key, "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stage(first.where("n > 1").select(F.col("payload_digest").alias("digest"), F.col("first.record_id").alias("refers_to"), F.col(f"first.{key}").alias("first_id")), "responses")
    joined = records.join(first, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= MIN_PAYLOAD) & (F.col("type") == "response") & F.col(key).isNotNull(), "left")
    revisit = F.col("digest").isNotNull() & (F.col(key) != F.col("first_id"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(WARC_VERSION + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("type"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("timestamp")),
        F.when(F.col("type") == "warcinfo", line("WARC-Filename", F.substring("url", len("filedesc://") + 1, 1 << 20))).otherwise(line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20"))),
        F.when(F.col("type").isin("warcinfo") | (F.col("ip") == "-"), F.lit("")).otherwise(line("WARC-IP-Address", F.col("ip"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.col("refers_to")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        F.when(F.col("cut"), line("WARC-Truncated", F.lit("unspecified"))).otherwise(F.lit("")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", (F.octet_length("http") + octets(payload)).cast("string")),
        F.lit(CRLF),
    )
    return joined.select(F.concat(header, F.col("http").cast("string"), payload).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """The archive of WARC records, ``record``."""
    _write(records, path, WARC_END)


WARC_ROWS = "page_id bigint, record_id string, record_type string, url string, timestamp string, payload_bytes bigint, payload_digest string, refers_to_id string, intact boolean"
_WARC_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("timestamp", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("intact", pa.bool_())])


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for stream in _files(batches):
            for header, block in parse_warc(stream):
                _, payload, fields = _http(block)
                declared = header.get("warc-payload-digest", "").removeprefix("sha256:")
                kind = header.get("warc-type", "")
                digest = declared if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                size = _number(fields.get("content-length")) if kind == "revisit" else len(payload)
                yield _number(fields.get("x-page-id")), header.get("warc-record-id"), kind, header.get("warc-target-uri"), header.get("warc-date"), size, digest, header.get("warc-refers-to"), digest == declared

    yield from _batches(rows(), _WARC_SCHEMA, lambda r: 500)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_ROWS of all records in a WARC archive; digests and sizes of responses are those of the payload read."""
    ship_package(spark)
    return read_files(spark, path).mapInArrow(_read_warc, WARC_ROWS)


def resolved(rows: DataFrame) -> DataFrame:
    """WARC_ROWS of captures with ``refers_to``, the page_id of the record that a revisit refers to."""
    rows = stage(rows.where(F.col("record_type").isin("response", "revisit")), "records")
    wanted = rows.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = stage(rows.select("record_id", F.col("page_id").alias("refers_to")).join(wanted, "record_id", "left_semi").dropDuplicates(["record_id"]), "targets")
    return rows.join(targets.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC archives of both versions, those to a WARC archive, and that read back."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    for version in (1, 2):
        write_arc(pages.where(F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(0)) == version - 1), f"{folder}/arc{version}", version)
    records = read_arc(spark, f"{folder}/arc1").unionByName(read_arc(spark, f"{folder}/arc2"))
    write_warc(convert(records), f"{folder}/warc")
    return resolved(read_warc(spark, f"{folder}/warc"))
