"""WARC archives: writing them, and reading them back by segment reassembly.

Writer: a response record per page, its HTTP message in chunked transfer
framing; of pages with equal payloads of at least ``min_bytes`` the one with
the largest id is the response and the others are revisit records that refer
to it. A record block over ``segment_bytes`` is segmented: the first record
carries WARC-Segment-Number 1, continuation records carry the id of the first
and their own number, the last also the total length. Archives are written
through Spark's own writer (gzip, ``\\r\\n\\r\\n`` after each record), so they
may lie in any store Spark knows.

Reader: archives, our own or others', are parsed by Content-Length. Unsegmented
responses are decoded on the spot; continuation records are grouped by origin
id, ordered by segment number, checked for gaps and total length, and decoded
as one block. Every payload's SHA-1 is compared with the digest its record
states, if it states one. Record ids are texts of any form; the page a record
belongs to is a field of its own and null where there is none. A record that
cannot be read (no usable length, cut off, broken inflation) gives a row that is
not intact, and reading goes on at the next record that can be found.

Defined results: a null payload counts as empty; rows that repeat a page id
and payload that is a response are responses each; a response that is
incomplete or fails its digest has ``intact`` false and null payload columns;
an empty table gives no rows; extra columns are ignored whatever their names.
Records of kinds other than response, revisit and continuation are passed over.
A file is read as one value, so it may hold 2 GB at most.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.common import attach, c, cut
from ledgerline.session import scratch_path

VERSION = b"WARC/1.1\r\n"
# Extension fields, which other readers pass over.
PAGE_FIELD, REFERS_FIELD = "Page-ID", "Refers-To-Page-ID"
RECORDS_PER_FILE = 2_000  # of a segment each at most: 130 MB before compression
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 16_384


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the UTF-8 text: five hex digits
    are 20 bits, four base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(text.cast("binary")), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    out = []
    for at in range(0, len(body), size):
        part = body[at:at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(framed: bytes) -> bytes | None:
    """The body of chunked framing, None if the framing is broken. Chunk
    extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or framed[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(framed[at:at + size])
        at += size + 2


def decode_message(block: bytes) -> bytes | None:
    """The payload of an HTTP response message, None if it is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = _fields(head)
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunk(body)
    return body


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(row, page, url, body, kind, digest, refers_to, segment_bytes) -> list[bytes]:
    """The record of a page, or its segments."""
    name = f"<urn:page:{'' if page is None else page}:{row}>"
    own_page = [] if page is None else [(PAGE_FIELD, str(page))]
    target = "".join(ch if ch.isprintable() else "%20" for ch in url or "")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Target-URI", target),
              ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response"), *own_page]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>"), (REFERS_FIELD, str(refers_to))]
        return [_record(fields, head + b"\r\n")]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body)
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"),
               ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name),
               ("WARC-Segment-Number", str(number)), *own_page]
        if at + segment_bytes >= len(block):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(own, block[at:at + segment_bytes]))
    return out


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write page_id, url, html rows as WARC files under ``path``."""
    body = F.coalesce(c("html"), F.lit(""))
    rows = pages.select(c("page_id").cast("long").alias("page_id"), c("url").cast("string").alias("url"),
                        body.alias("html"), base32_sha1(body).alias("digest"))
    groups = cut(rows.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")))
    named = attach(rows, groups, "digest", "copies", salt_by="page_id")
    revisit = (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    planned = named.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", F.col("html").cast("binary").alias("body"),
        F.when(revisit, "revisit").otherwise("response").alias("kind"), "digest", "response_id")

    def build(batches):
        for batch in batches:
            out: list[bytes] = []
            for fields in zip(*(col.to_pylist() for col in batch.columns)):
                out += page_records(*fields, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # A cast from binary to string keeps the bytes as they are.
    records = planned.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


class _Stream:
    """Bytes of a file, inflated as they are asked for (gzip members in a row, or plain)."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer = raw, 0, bytearray()
        self.broken = self.begun = False  # inflation failed or stopped short; inside a member
        self.inflate = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        part = self.raw[self.at:self.at + 1_048_576]
        self.at += len(part)
        if self.inflate is None:
            self.buffer += part
            return bool(part)
        if not part:
            self.broken |= self.begun  # the last member has no end
            return False
        try:
            while part:
                self.buffer += self.inflate.decompress(part)
                self.begun, part = not self.inflate.eof, self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
        except zlib.error:
            self.broken, self.begun, self.at = True, False, len(self.raw)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``, which is passed over; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(raw: bytes):
    """(fields, block) of each record of an archive file; the block is None where it
    cannot be delimited or is cut off."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        fields, length = _fields(head), None
        if head.startswith(b"WARC/"):
            length = _number(fields.get(b"content-length"))
        if length is None:
            yield fields, None
            if not stream.buffer.lstrip(b"\r\n").startswith(b"WARC/"):
                if stream.until(b"\r\nWARC/") is None:
                    break
                stream.buffer[:0] = b"WARC/"
            continue
        block = stream.take(length)
        if len(block) < length:  # the file ends here
            yield fields, None
            return
        yield fields, block
    if stream.broken or stream.buffer.strip():
        yield {}, None


def _number(text: bytes | None) -> int | None:
    """A decimal field as a bigint."""
    text = (text or b"").strip()
    return int(text) if text.isdigit() and len(text) < 19 else None


READ = ("origin string, page_id long, kind string, segment long, total long, stated string, refers_to long, "
        "payload_bytes long, payload_digest string, block binary")
READ_ARROW = pa.schema([
    ("origin", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("segment", pa.int64()),
    ("total", pa.int64()), ("stated", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("block", pa.binary())])


def _measure(block: bytes | None) -> tuple[int | None, str | None]:
    """Payload size and digest of an HTTP message block."""
    import base64
    import hashlib

    body = None if block is None else decode_message(block)
    if body is None:
        return None, None
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def _read_record(fields: dict[bytes, bytes], block: bytes | None) -> tuple | None:
    def text(name: bytes) -> str | None:
        return fields[name].decode(errors="replace") if name in fields else None

    def signed(name: str) -> int | None:
        value = fields.get(name.lower().encode(), b"")
        number = _number(value.removeprefix(b"-"))
        return -number if number is not None and value[:1] == b"-" else number

    kind, name = text(b"warc-type"), text(b"warc-record-id")
    if block is None:
        return name, signed(PAGE_FIELD), "broken", None, None, None, None, None, None, None
    if kind not in ("response", "revisit", "continuation"):
        return None
    stated = _stated(text(b"warc-payload-digest"))
    segment = _number(fields.get(b"warc-segment-number"))
    if segment is not None or kind == "continuation":
        origin = name if segment == 1 else text(b"warc-segment-origin-id")
        total = _number(fields.get(b"warc-segment-total-length"))
        return origin, signed(PAGE_FIELD), kind, segment or 0, total, stated, None, None, None, block
    size, digest = _measure(block) if kind == "response" else (None, None)
    return name, signed(PAGE_FIELD), kind, None, None, stated, signed(REFERS_FIELD), size, digest, None


def _stated(digest: str | None) -> str | None:
    """A stated SHA-1 in base32; None for none, or one of another kind."""
    import base64

    method, _, value = (digest or "").strip().partition(":")
    if method.lower() != "sha1":
        return None
    try:
        return base64.b32encode(bytes.fromhex(value)).decode() if len(value) == 40 else value.upper()
    except ValueError:
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(READ_ARROW.names, r)) for r in rows], schema=READ_ARROW)


def reassemble(table: pa.Table) -> pa.Table:
    """The segments of one origin id as one record; without a payload if a
    segment is missing or doubled or the total length differs."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["segment"], r["stated"] is None))
    numbers = [r["segment"] for r in rows]
    block = b"".join(r["block"] for r in rows)
    whole = numbers == list(range(1, len(rows) + 1)) and rows[-1]["total"] == len(block)
    size, digest = _measure(block if whole else None)
    first = rows[0] | {"kind": "response", "segment": None, "total": None, "payload_bytes": size,
                       "payload_digest": digest, "block": None}
    return pa.Table.from_pylist([first], schema=READ_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type
    (``broken``: a record that could not be read), refers_to, intact, record_id."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                out, held = [], 0
                for fields, block in records(raw.as_py()):
                    if (row := _read_record(fields, block)) is not None:
                        out.append(row)
                        held += len(row[-1] or b"")
                    if len(out) >= 5_000 or held > 8_000_000:
                        yield _batch(out)
                        out, held = [], 0
                yield _batch(out)

    found = cut(files.mapInArrow(parse, READ))
    joined = found.where("segment is not null").groupBy("origin").applyInArrow(reassemble, READ)
    named = cut(found.where("segment is null").unionByName(joined).drop("segment", "total", "block"))
    # A revisit's payload is that of the responses with the digest it states.
    revisits = named.where("kind = 'revisit'").select("origin", "page_id", "refers_to", F.col("stated").alias("digest"))
    whole = F.col("payload_digest").isNotNull() & (F.col("stated").isNull() | (F.col("payload_digest") == F.col("stated")))
    targets = named.where("kind = 'response'").where(whole).groupBy(F.col("payload_digest").alias("digest")).agg(
        F.first("payload_bytes").alias("payload_bytes"))
    uses = revisits.groupBy("digest").agg(F.count("*").alias("uses"))
    targets = cut(uses.join(targets, "digest", "left"))
    seen = attach(revisits, targets, "digest", "uses", salt_by="page_id")
    known = F.col("payload_bytes").isNotNull()
    return named.where("kind <> 'revisit'").select(
        "page_id", F.when(whole, F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("payload_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), whole.alias("intact"),
        F.col("origin").alias("record_id"),
    ).unionByName(seen.select(
        "page_id", "payload_bytes", F.when(known, F.col("digest")).alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to", known.alias("intact"), F.col("origin").alias("record_id")))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * j} & 31)::INT, 1)"
    for i in range(8) for j in range(4))
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
