"""Operator 1: converter of legacy ARC archives to WARC, with writers and readers for both.

ARC.  A file opens with a ``filedesc://`` record whose block names the version and the header fields;
version 1 gives each record ``URL IP-address Archive-date Content-type Archive-length``, version
2 ``URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename
Archive-length``.  The declared length alone says where a record ends.

Conversion.  Each ARC record gets a WARC-Record-ID (a name-based UUID of archive and offset, so
a repeated task writes the same one), a WARC-Date from the 14-digit Archive-date, a type (``warcinfo``
for filedesc, ``response`` for HTTP messages, ``resource`` for the rest) and bare base32 SHA-1 digests of block and
payload.  Of responses with the same payload digest and length, the one with the smallest id stays; the
others become ``revisit`` records that keep only the HTTP head and refer to it.

Files are written by Spark's text writer (record bytes as lines, gzip over the file), so any
store that Spark reaches will do; a whole file is read as one row, but unpacked and parsed as a
stream, one record in memory at a time.

Defined results: null payloads are empty; a null or blank URL is written as ``urn:none``; a null
id has no header and reads back as null, and gives way to any other id as the response; rows that
repeat an id are told apart by archive and offset (the first is the response); a malformed date becomes
1970-01-01; an empty table gives archives without records; records beyond 2 GB do not fit a row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.plans.shared import shared_path, write_shared

ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID_HEADER = "X-Page-Id"
#: A group of equal payloads is hot from this share of a task's even load on: there are at most so many for each task.
HOT_SHARES = 4
CHUNK = 1 << 20

LINES = T.StructType([T.StructField("record", T.BinaryType())])
PARSED = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("position", T.LongType()), T.StructField("version", T.IntegerType()),
    T.StructField("url", T.StringType()), T.StructField("ip", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("head", T.BinaryType()), T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
])
WARC_ROWS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("refers_to_record", T.StringType()), T.StructField("refers_to_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_record(version: int, url: str, ip: str, date: str, content_type: str, block: bytes, status: int = 200) -> bytes:
    if version == 1:
        line = f"{url} {ip} {date} {content_type} {len(block)}"
    else:
        line = f"{url} {ip} {date} {content_type} {status} {digest_of(block)} - 0 - {len(block)}"
    return line.encode() + b"\n" + block + b"\n"


def arc_filedesc(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 framesift\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", block)


def safe_url(url: str | None) -> str:
    """A URL without white space or control characters, as a header field needs it."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:none"


def _to_arc(version_of, date: str):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = version_of(part)
        yield (arc_filedesc(version, f"part-{part:05d}.arc", date)[:-1],)
        for page_id, url, html in rows:
            payload = (html or "").encode("utf-8", "replace")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            head += f"{ID_HEADER}: {page_id}\r\n\r\n" if page_id is not None else "\r\n"
            yield (arc_record(version, safe_url(url), "0.0.0.0", date, "text/html", head.encode() + payload)[:-1],)

    return run


def write_records(records: DataFrame, path: str) -> str:
    """Write the binary column ``record`` (each without its last line feed) as gzip files below ``path``."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


def write_arc(pages: DataFrame, path: str, version_of=lambda part: 1 + part % 2, date: str = "20240101000000") -> str:
    """Write (page_id, url, html) as ARC files, one for each partition, in the version the partition gets."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return write_records(map_rows(rows, _to_arc(version_of, date), LINES, weight=lambda r: len(r[0]), slice_rows=64), path)


class ByteStream:
    """Lines and exact lengths from a whole file's bytes, gunzipped bit by bit where they are gzip."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.buffer, self.done = memoryview(data), 0, bytearray(), 0
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data) and not (self.zip and self.zip.unconsumed_tail):
            return False
        if self.zip is None:
            self.buffer += self.data[self.at : self.at + CHUNK]
            self.at += CHUNK
            return True
        chunk = self.zip.unconsumed_tail or self.data[self.at : self.at + CHUNK]
        if not self.zip.unconsumed_tail:
            self.at += len(chunk)
        self.buffer += self.zip.decompress(chunk, 4 * CHUNK)
        if self.zip.eof:  # the next member, as one for each record is usual
            self.at -= len(self.zip.unused_data)
            self.zip = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                if not self.buffer:
                    return None
                end = len(self.buffer)
                self.buffer += b"\n"
                break
        out = bytes(self.buffer[:end])
        self._drop(end + 1)
        return out.rstrip(b"\r")

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError(f"the file ends {n - len(self.buffer)} bytes before the declared length")
        out = bytes(self.buffer[:n])
        self._drop(n)
        return out

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.done += n


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the blank line) and payload of an HTTP message; no message: empty head."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    end = min(ends, default=len(block))
    return block[:end], block[end:]


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _whole(text: str | None) -> int | None:
    """A signed 64-bit number, or none."""
    number = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


#: A header line up to its date: the last address and date that stand together, so that a URL may hold spaces.
_UP_TO_DATE = re.compile(r"(.*) ([0-9A-Fa-f.:]+|-) ([0-9]{4,14}) (.*)", re.S)


def header_fields(line: str, version: int | None) -> list[str] | None:
    """URL, address, date and content type, then the version's other fields, length last; None if the line is no header.

    The length and what stands before it are counted from the right, so that a content type may hold spaces; without a version the type is one word.
    """
    found = _UP_TO_DATE.fullmatch(line)
    if not found:
        return None
    rest = found[4].rsplit(" ", len(ARC_FIELDS[version]) - 4) if version else found[4].split(" ")
    return [*found.groups()[:3], *rest] if len(rest) >= 2 and rest[-1].isdigit() else None


def parse_arc(archive: str, data: bytes) -> Iterator[tuple]:
    """Records of one ARC file as ``PARSED`` rows; the header line's fields follow the version block."""
    stream, version = ByteStream(data), 1
    while True:
        position = stream.done
        line = stream.line()
        if line is None:
            return
        if not line:
            continue
        filedesc = line.startswith(b"filedesc:")  # says its own version, so its header line may have either form
        fields = header_fields(line.decode("utf-8", "replace"), None if filedesc else version)
        if fields is None:
            raise ValueError(f"{archive}: no ARC header line at byte {position}")
        block = stream.exactly(int(fields[-1]))
        url, ip, date, content_type = fields[:4]
        if filedesc:
            version = 2 if block[:1] == b"2" else 1
            yield archive, position, version, url, ip, date, "warcinfo", content_type, None, b"", block, len(block), digest_of(block)
            continue
        head, payload = http_parts(block)
        kind = "response" if head else "resource"
        yield archive, position, version, url, ip, date, kind, content_type, _whole(header_value(head, ID_HEADER)), head, payload, len(payload), digest_of(payload)


def _each_file(parse):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for path, content in rows:
            if content:
                yield from parse(path.rsplit("/", 1)[-1], content)

    return run


def read_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path`` with archive name, position, version, header fields, head, payload and digest."""
    return map_rows(read_files(spark, path), _each_file(parse_arc), PARSED, weight=lambda r: len(r[10]), slice_rows=1)


def warc_date(arc_date: str | None) -> str:
    """ISO time of a 14-digit (or shorter, padded) ARC date; 1970-01-01 if it is none."""
    digits = arc_date if arc_date and re.fullmatch(r"[0-9]{8}|[0-9]{10}|[0-9]{12}|[0-9]{14}", arc_date) else "19700101"
    d = digits.ljust(14, "0")
    if not ("01" <= d[4:6] <= "12" and "01" <= d[6:8] <= "31" and d[8:10] < "24" and d[10:12] < "60" and d[12:] < "60"):
        d = "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(archive: str, position: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{position}')}>"


def warc_record(kind: str, archive: str, position: int, url: str, ip: str, date: str, content_type: str, head: bytes, payload: bytes, digest: str, original: tuple | None) -> bytes:
    """One WARC/1.0 record; ``original``: (archive, position, date, id) of the response a revisit refers to."""
    revisit = original is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if revisit else kind}", f"WARC-Record-ID: {record_id(archive, position)}", f"WARC-Date: {warc_date(date)}",
        f"WARC-Target-URI: {url}" if kind != "warcinfo" else f"WARC-Filename: {archive}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {digest_of(block)}",
    ]
    if ip and ip != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {ip}")
    if revisit:
        to_archive, to_position, to_date, to_id = original
        lines += [f"WARC-Refers-To: {record_id(to_archive, to_position)}", f"WARC-Refers-To-Date: {warc_date(to_date)}", f"WARC-Profile: {REVISIT_PROFILE}"]
        lines += [f"X-Refers-To-Page: {to_id}"] if to_id is not None else []
    kind_of = "application/http; msgtype=response" if head else "application/warc-fields" if kind == "warcinfo" else content_type or "application/octet-stream"
    lines += [f"Content-Type: {kind_of}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _to_warc(rows: Iterator[tuple]) -> Iterable[tuple]:
    for archive, position, url, ip, date, kind, content_type, head, payload, digest, to_archive, to_position, to_date, to_id in rows:
        original = (to_archive, to_position, to_date, to_id) if to_archive is not None else None
        yield (warc_record(kind, archive, position, url, ip, date, content_type, head, payload, digest, original)[:-1],)


def find_responses(parsed: DataFrame) -> DataFrame:
    """For payloads of more than one response: digest, length and the record that stays."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "archive", "position", "date")
    groups = parsed.where("record_type = 'response'").groupBy("payload_digest", "payload_bytes")
    return groups.agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes"),
        F.col("first.archive").alias("to_archive"), F.col("first.position").alias("to_position"), F.col("first.date").alias("to_date"), F.col("first.id").alias("to_id"), "n",
    )


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> str:
    """Convert all ARC files below ``arc_path`` to WARC files below ``warc_path``; returns that path."""
    parsed = read_arc(spark, arc_path)
    firsts = write_shared(find_responses(parsed), "responses")
    # groups with more rows than a task's even share of a quarter: at most HOT_SHARES for each task, whatever the data, so they are broadcast
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARES * parts > total
    to = ["to_archive", "to_position", "to_date", "to_id"]
    near = F.broadcast(firsts.where(hot).select("of_digest", "of_bytes", *to))
    is_response = parsed["record_type"] == "response"
    known = parsed.join(near, is_response & (parsed["payload_digest"] == F.col("of_digest")) & (parsed["payload_bytes"] == F.col("of_bytes")), "left").drop("of_digest", "of_bytes")
    # rows of hot groups have their response already; a key of their own deals them evenly in the join with all other groups
    own = F.when(F.col("to_archive").isNull() & (F.col("record_type") == "response"), F.col("payload_digest")).otherwise(F.concat_ws(":", F.lit("row"), "archive", F.col("position").cast("string")))
    others = firsts.where(~hot).select("of_digest", "of_bytes", *[F.col(c).alias(f"_{c}") for c in to])
    joined = known.withColumn("_key", own).join(others, (F.col("_key") == F.col("of_digest")) & (F.col("payload_bytes") == F.col("of_bytes")), "left")
    told = joined.withColumns({c: F.coalesce(c, f"_{c}") for c in to})
    itself = (F.col("archive") == F.col("to_archive")) & (F.col("position") == F.col("to_position"))
    told = told.withColumns({c: F.when(~itself, F.col(c)) for c in reversed(to)}).withColumn("payload", F.when(F.col("to_archive").isNull(), F.col("payload")))
    rows = told.select("archive", "position", "url", "ip", "date", "record_type", "content_type", "head", "payload", "payload_digest", *to)
    return write_records(map_rows(rows, _to_warc, LINES, weight=lambda r: len(r[0]), slice_rows=64), warc_path)


def parse_warc(archive: str, data: bytes) -> Iterator[tuple]:
    """Records of one WARC file as ``WARC_ROWS`` rows; digests of whole payloads are computed anew."""
    stream = ByteStream(data)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no WARC record at byte {stream.done}")
        fields: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.exactly(int(fields["content-length"]))
        head, payload = http_parts(block)
        kind = fields["warc-type"]
        revisit = kind == "revisit"
        length = _whole(header_value(head, "Content-Length")) if revisit else len(payload)
        digest = fields.get("warc-payload-digest") if revisit else digest_of(payload)
        yield (
            archive, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), _whole(header_value(head, ID_HEADER)),
            fields.get("warc-refers-to"), _whole(fields.get("x-refers-to-page")), length, digest, None if revisit else payload,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All WARC records below ``path``."""
    return map_rows(read_files(spark, path), _each_file(parse_warc), WARC_ROWS, weight=lambda r: len(r[10] or b""), slice_rows=1)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Write the pages as ARC files of both versions, convert those to WARC, and read the WARC records back."""
    spark = pages.sparkSession
    arc = write_arc(pages, shared_path(spark, "arc"))
    return read_warc(spark, convert_arc(spark, arc, shared_path(spark, "warc")))
