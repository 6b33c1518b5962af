"""WARC files of other writers: any record id, absent or broken fields, cut-off files."""

import base64
import gzip
import hashlib
import os
import uuid

from ledgerline.llm import warc
from ledgerline.session import scratch_path

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def sha1(body, form=base64.b32encode):
    return form(hashlib.sha1(body).digest()).decode()


def record(kind, block, *fields, length=True, name=None):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name or f'<urn:uuid:{uuid.uuid4()}>'}", *fields]
    if length:
        head.append(f"Content-Length: {len(block) if length is True else length}")
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read(spark, files):
    path = scratch_path(spark, f"foreign_{uuid.uuid4().hex}").removeprefix("file:")
    os.makedirs(path)
    for name, data in files.items():
        with open(f"{path}/{name}", "wb") as out:
            out.write(data)
    return warc.read_archives(spark, path).collect()


def rows(got):
    return sorted(((r.record_type, r.payload_bytes, r.intact, r.page_id) for r in got), key=str)


def test_ids_digests_and_kinds_of_other_writers(spark):
    body = b"<p>one</p>"
    cut = HTTP + b"x" * 50
    segments = [
        record("response", cut[:30], "WARC-Segment-Number: 1", name="<urn:uuid:origin>"),
        record("continuation", cut[30:], "WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:uuid:origin>",
               f"WARC-Segment-Total-Length: {len(cut)}"),
        record("continuation", b"lost", "WARC-Segment-Number: 2", "WARC-Segment-Origin-ID: <urn:uuid:gone>")]
    data = (record("warcinfo", b"software: x\r\n") + record("request", b"GET / HTTP/1.1\r\n\r\n")
            + record("response", HTTP + body, f"WARC-Payload-Digest: sha1:{sha1(body)}", name="<urn:uuid:a>")
            + record("response", HTTP + body, f"WARC-Payload-Digest: SHA1:{sha1(body, lambda d: d.hex().encode())}")
            + record("response", HTTP + body, "WARC-Payload-Digest: sha256:00")
            + record("response", HTTP + body)
            + record("response", HTTP + body, f"WARC-Payload-Digest: sha1:{sha1(b'other')}", name="no urn \xe9 at all")
            + record("response", b"no message", name="x")
            + record("revisit", HTTP, f"WARC-Payload-Digest: sha1:{sha1(body)}", "WARC-Refers-To: <urn:uuid:a>")
            + record("revisit", HTTP, "WARC-Refers-To: <urn:uuid:a>")
            + record("response", HTTP + b"own", "Page-ID: -12") + record("response", HTTP + b"own", "Page-ID: 1x")
            + b"".join(segments))
    got = read(spark, {"a.warc": data, "b.warc.gz": b"".join(gzip.compress(x) for x in segments[:2])})
    assert rows(got) == sorted([
        ("response", 10, True, None)] * 4 + [("response", None, False, None)] * 2 + [
        ("revisit", 10, True, None), ("revisit", None, False, None), ("response", 3, True, -12), ("response", 3, True, None),
        ("response", None, False, None), ("response", None, False, None)], key=str)
    assert {"<urn:uuid:a>", "no urn \xe9 at all", "x"} <= {r.record_id for r in got}


def test_broken_records_are_rows_and_reading_goes_on(spark):
    good = record("response", HTTP + b"good")
    for bad in (record("response", HTTP + b"no length", length=False), record("response", HTTP + b"x", length="many"),
                record("response", HTTP + b"x", length="-5"), b"noise without a head\r\n\r\n"):
        got = read(spark, {"a.warc": good + bad + good, "b.warc.gz": gzip.compress(good + bad) + gzip.compress(good)})
        assert rows(got) == sorted([("response", 4, True, None)] * 4 + [("broken", None, False, None)] * 2, key=str)


def test_cut_off_files(spark):
    good = record("response", HTTP + b"good")
    long = record("response", HTTP + os.urandom(4_000), name="<urn:uuid:long>")
    got = read(spark, {"a.warc": good + long[:1_000], "b.warc.gz": gzip.compress(good) + gzip.compress(long)[:2_000],
                       "c.warc": good + b"WARC/1.0\r\nWARC-Type: resp", "d.warc.gz": gzip.compress(good) + b"\x1f\x8bnoise",
                       "e.warc": b"", "f.warc": b"\r\n\r\n"})
    assert rows(got) == sorted([("response", 4, True, None)] * 4 + [("broken", None, False, None)] * 4, key=str)
    assert sum(r.record_id == "<urn:uuid:long>" for r in got) == 2


def test_records_are_bounded_by_a_segment():
    parts = warc.page_records(1, 9, "u", b"x" * 1_000_000, "response", "D", None, warc.SEGMENT_BYTES)
    assert max(map(len, parts)) < warc.SEGMENT_BYTES + 1_000
