"""Legacy ARC archives converted to WARC files, and WARC files read back.

An ARC file opens with a filedesc record whose second line names the version; version 1 header lines have five
fields, version 2 ten, and in both the last is the declared length of what follows. Each ARC record becomes a
WARC record: the filedesc a warcinfo, a web address a response, anything else a resource. Identifiers are made
from the record's content and place, so a task that runs again makes the same ones; timestamps come from the
14-digit archive date, digests from the bytes. Of equal payloads of at least REVISIT_BYTES bytes, one stays a
response and the others become revisits of it.

Payloads are bytes all the way, whatever they hold; ARC files may be gzip-compressed, as a whole or by records. WARC
files hold one gzip member a record and about FILE_BYTES each. They are written by Spark's text writer, whose row
separator is set to the zero byte that ends every member of under 16 MB (the top of its length), and read with Spark's
binary reader and cut by declared lengths, so both work on any file system that Spark has. A record of 16 MB or more
takes several members.

A null payload is empty; an empty payload is a record like any other. A null id gives no id header and reads back
as null. Repeated rows each give a record. An empty table gives no response records. A URL is written with its
white space and controls percent-encoded, a null URL as "-"; what was not http becomes a resource record. A record
that declares more bytes than there are, or a header line with too few fields, is an error, not a silent loss.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import discard, materialise, read_table, session_defaults, shared_folder, tidy

REVISIT_BYTES = 1000
#: Uncompressed bytes of records after which a task begins another file, and the bytes that one gzip member holds at most.
FILE_BYTES, MEMBER_BYTES = 64 << 20, (16 << 20) - 1
#: At most so many leaders (about 300 bytes each) are broadcast; more meet the records in a join that shuffles them.
BROADCAST_LEADERS = 100_000
#: Header fields by ARC version, and the WARC revisit profile.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target_uri string, record_date string, ip string, content_type string, page_id bigint, http_head binary, payload binary, payload_bytes bigint, payload_sha1 string"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _escaped(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_record(version: int, url: str, date: str, mime: str, body: bytes, offset: int = 0, name: str = "-", ip: str = "0.0.0.0") -> bytes:
    fields = [url, ip, date, mime]
    if version == 2:
        fields += ["200", hashlib.sha1(body).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_opening(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 quillstat\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", date, "text/plain", body, 0, name)


def parse_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of each record, by the field list of the file's own version. The content may be
    gzip-compressed; offsets are those of the uncompressed file."""
    stream, fields = _Stream(content), None
    while True:
        at = stream.place
        raw = stream.line(b"\n")
        if raw is None:
            return
        line = raw.rstrip(b"\r").decode("utf-8", "replace")
        if not line:
            continue
        if fields is None:  # the version stands in the first record's body; in any version its length ends the line
            body = stream.take(_length(line, at))
            fields = ARC_FIELDS[int(body.split(None, 1)[0])]
            values = line.rsplit(" ", len(fields) - 1)
        else:
            values = line.rsplit(" ", len(fields) - 1)
            body = stream.take(_length(line, at)) if len(values) == len(fields) else b""
        if len(values) != len(fields):
            raise ValueError(f"ARC header line at {at} has {len(values)} of {len(fields)} fields")
        yield at, dict(zip(fields, values, strict=True)), body


def _length(line: str, at: int) -> int:
    last = line.rpartition(" ")[2]
    if not last.isdecimal():
        raise ValueError(f"ARC header line at {at} has fields that end with no length")
    return int(last)


def _converted(name: str, content: bytes) -> Iterator[tuple]:
    for offset, head, body in parse_arc(content):
        url, date = head["URL"], head["Archive-date"]
        made = hashlib.sha1(f"{name}\0{offset}\0{url}\0{date}\0".encode() + body).digest()[:16]
        when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
        kind, http, page = "resource", b"", None
        payload = body
        if url.startswith("filedesc://"):
            kind = "warcinfo"
        elif body.startswith(b"HTTP/"):
            cut = body.find(b"\r\n\r\n")
            http, payload = (body[: cut + 4], body[cut + 4 :]) if cut >= 0 else (body, b"")
            kind = "response"
            found = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", http)
            page = int(found[1]) if found else None
        yield f"<urn:uuid:{uuid.UUID(bytes=made, version=5)}>", kind, url, when, head["IP-address"], head["Content-type"], page, http, payload, len(payload), hashlib.sha1(payload).hexdigest()


def convert_arc(archives: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """WARC record fields (RECORD) of every record in ARC files given as rows, as the binary reader gives them."""
    session_defaults(archives.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n in ("http_head", "payload") else pa.string() for n in names]
        for batch in batches:
            rows, held = [], 0
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _converted(name, content.as_buffer().to_pybytes()):
                    rows.append(row)
                    held += row[9]
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select(F.col(name_col).cast("string").alias("path"), F.col(content_col).alias("content")).mapInArrow(tidy(run), RECORD)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(path, content): legacy archives of page_id, url, html, a batch of pages each, in either version."""
    session_defaults(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            ids, urls, texts = (c.to_pylist() for c in batch.columns)
            if not ids:
                continue
            version = 1 + (part + k) % 2
            name = f"pages-{part:06d}-{k:06d}.arc"
            out = io.BytesIO()
            out.write(arc_opening(version, name, "20240101000000"))
            for i, u, t in zip(ids, urls, texts, strict=True):
                html = (t or "").encode()
                own = "" if i is None else f"X-Page-Id: {i}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode()
                second = (i or 0) % 86400
                date = f"20240101{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
                out.write(arc_record(version, _escaped(u), date, "text/html", http + html, out.tell(), name))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(tidy(run), "path string, content binary")


def mark_revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Add refers_to_id, refers_to_uri, refers_to_date; of equal large payloads that with the largest page_id stays.

    Payloads are equal if length and SHA-1 are. The leaders are one slim row for each payload that occurs twice
    or more; the records meet them in a join that can be split, however many share one payload.
    """
    large = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least)
    leader = F.max(F.struct("page_id", "record_id", F.col("target_uri").alias("uri"), F.col("record_date").alias("date"))).alias("lead")
    leaders = records.filter(large).groupBy("payload_sha1", "payload_bytes").agg(leader, F.count("*").alias("n")).filter("n > 1").drop("n")
    leaders = materialise(leaders.withColumnRenamed("payload_bytes", "lead_bytes").withColumnRenamed("payload_sha1", "lead_sha1"))
    if leaders.count() <= BROADCAST_LEADERS:
        leaders = F.broadcast(leaders)
    match = (F.col("payload_sha1") == F.col("lead_sha1")) & (F.col("payload_bytes") == F.col("lead_bytes")) & large
    both = records.join(leaders, match, "left")
    other = F.col("lead").isNotNull() & (F.col("record_id") != F.col("lead.record_id"))
    return both.select(
        *[c for c in records.columns if c != "record_type"],
        F.when(other, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        *[F.when(other, F.col(f"lead.{f}")).alias(a) for f, a in (("record_id", "refers_to_id"), ("uri", "refers_to_uri"), ("date", "refers_to_date"))],
    )


def write_warc(records: DataFrame, path: str) -> None:
    """WARC/1.1 records, a gzip member each, in files of about FILE_BYTES."""

    def header(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    block = F.concat("http_head", F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload")))
    http = F.col("record_type").isin("response", "revisit")
    made = records.withColumn("block", block)
    digest = F.concat(F.lit("sha1:"), F.col("payload_sha1"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Date", F.col("record_date")),
        header("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("target_uri"))),
        header("WARC-IP-Address", F.when(F.col("ip") != "0.0.0.0", F.col("ip"))),
        header("WARC-Payload-Digest", F.when(http, digest)),
        header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(REVISIT_PROFILE))),
        header("WARC-Refers-To", F.col("refers_to_id")),
        header("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        header("WARC-Refers-To-Date", F.col("refers_to_date")),
        header("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).when(F.col("record_type") == "warcinfo", F.lit("application/warc-fields")).otherwise(F.col("content_type"))),
        F.lit("Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    whole = made.select(F.concat(F.encode(head, "UTF-8"), F.col("block"), F.lit("\r\n\r\n").cast("binary")).alias("record"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, held = 0, 0
        for batch in batches:
            rows, volumes = [], []
            for record in batch.column(0):
                raw = record.as_buffer()
                if held and held + len(raw) > FILE_BYTES:
                    volume, held = volume + 1, 0
                held += len(raw)
                rows.append(b"".join(map(member, (raw[k : k + MEMBER_BYTES] for k in range(0, len(raw), MEMBER_BYTES))))[:-1])
                volumes.append(volume)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(volumes, pa.int32())], names=["value", "volume"])

    files = whole.mapInArrow(tidy(compress), "value binary, volume int").select(F.col("value").cast("string").alias("value"), "volume")
    files.write.option("lineSep", "\0").option("compression", "none").partitionBy("volume").text(path)


def member(raw: bytes) -> bytes:
    """A gzip member; its last byte is 0, as it is the top of a length of under 16 MB."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Stream:
    """Bytes of one file, decompressed as they are asked for; `place` counts the bytes given out."""

    def __init__(self, content: bytes):
        self.content, self.at, self.rest, self.place = content, 0, b"", 0
        self.plain = not content.startswith(b"\x1f\x8b")
        self.inflate = None if self.plain else zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.content) and not (self.inflate and self.inflate.unused_data):
            return False
        part = self.content[self.at : self.at + (1 << 18)]
        self.at += len(part)
        if self.plain:
            self.rest += part
            return True
        if self.inflate.eof:  # the next gzip member
            part, self.inflate = self.inflate.unused_data + part, zlib.decompressobj(31)
        self.rest += self.inflate.decompress(part)
        return True

    def line(self, end: bytes = b"\r\n") -> bytes | None:
        """Up to the next line end; what stands behind the last one is a line too, and nothing is None."""
        while (k := self.rest.find(end)) < 0:
            if not self._more():
                break
        if k < 0:
            k = len(self.rest)
        out, behind = self.rest[:k], self.rest[k : k + len(end)]
        self.rest = self.rest[k + len(end) :]
        self.place += k + len(behind)
        return out if out or behind else None

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.rest and not self._more():
                raise ValueError("a record declares more bytes than the file has")
            part, self.rest = self.rest[: n - have], self.rest[n - have :]
            parts.append(part)
            have += len(part)
        self.place += n
        return b"".join(parts)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = _Stream(content)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.take(int(head["content-length"]))


READ = "record_id string, record_type string, target_uri string, record_date string, refers_to_id string, page_id bigint, declared_sha1 string, payload_sha1 string, payload_bytes bigint, block binary"


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row a record (READ). payload_sha1 and payload_bytes are measured; those of a revisit, whose record has
    no payload, are what its headers declare."""
    session_defaults(spark)
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary() if n == "block" else pa.int64() if n in ("page_id", "payload_bytes") else pa.string() for n in names]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse_warc(content.as_buffer().to_pybytes()):
                    kind = head.get("warc-type")
                    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    http, payload = block[:cut], block[cut:]
                    page = re.search(rb"(?im)^X-Page-Id: *(-?\d+)", http)
                    declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    if re.fullmatch("[A-Z2-7]{32}", declared):
                        declared = base64.b32decode(declared).hex()
                    if kind == "revisit":
                        size = re.search(rb"(?im)^Content-Length: *(\d+)", http)
                        sha1, size = declared, int(size[1]) if size else None
                    else:
                        sha1, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    rows.append((head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), int(page[1]) if page else None, declared or None, sha1, size, block if with_block else None))
                    held += len(block) * with_block
                    if held > 4 << 20 or len(rows) >= 2000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), READ)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    convert_arc(pages_to_arc(read_table(spark, sf_dir, "pages"))).write.parquet(f"{folder}/records")
    write_warc(mark_revisits(spark.read.parquet(f"{folder}/records")), f"{folder}/archives")
    back = materialise(read_warc(spark, f"{folder}/archives", with_block=False).filter("record_type in ('response', 'revisit')").drop("block"))
    discard(spark, folder)
    lead = back.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = back.filter("record_type = 'revisit'").join(lead, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type"]
    return revisits.select(*columns, "refers_to").unionByName(back.filter("record_type = 'response'").select(*columns, F.lit(None).cast("bigint").alias("refers_to")))


OP5_SQL = """
WITH sized AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), led AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS lead FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND lead <> page_id THEN lead END AS refers_to
FROM led
"""
