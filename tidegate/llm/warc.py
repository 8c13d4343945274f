"""WARC archives: written and read by tasks, one gzip member a record, with revisits for repeated payloads.

Archives lie in the cluster's shared folder (any file system that pyarrow opens by its URI). Each attempt of a
task writes files with names of its own, and only the files named in the table that Spark commits are read, so
a task that is run again leaves nothing twice.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import bounded, written
from tidegate.llm.keyed import matched
from tidegate.session import scratch

#: An archive is closed at this many records or bytes of payload, so that readers and runs stay bounded.
RECORDS, BYTES = 20_000, 256 << 20
_BLOCK = 1 << 20
_FILES = "file string, n_records long, n_bytes long"
CAPTURE = (
    "run string, url_key string, captured_us long, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, offset long, length long"
)
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)")


def url_key(url: str) -> str:
    """Sort key of a URL: its host's labels reversed, then the path; scheme, fragment and usual ports left out."""
    host, port, rest = _URL.match(url).groups()
    port = "" if port in (None, ":80", ":443") else port
    return ",".join(reversed(host.lower().split("."))) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1: five bytes are eight digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload(html: str = "html") -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html, captured_us) as records: of equal payloads of at least `least_bytes` the one
    with the smallest page_id is the response (all rows of that id, where it repeats; all rows where no id is
    known), the others revisit it. Null html is an empty payload; null ids come after all others."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"),
        F.coalesce(F.col("captured_us").cast("long"), F.lit(0)).alias("captured_us"),
    )
    rows = rows.withColumns({"payload_digest": digest(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    several = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    firsts = several.agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1")
    placed = matched(rows, written(firsts, "payloads"), ["payload_digest", "payload_bytes"], "_n", "left")
    other = F.coalesce(F.col("page_id") > F.col("first_id"), F.col("first_id").isNotNull() & F.col("page_id").isNull())
    return placed.withColumn("refers_to", F.when(other, F.col("first_id"))).drop("first_id", "_n")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, captured_us: int, payload: bytes, digested: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the head of the response, with the payload's length, and not the payload."""
    when = datetime.fromtimestamp(captured_us // 1_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{captured_us % 1_000_000:06d}Z"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {when}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha1:{digested}")
    if revisit:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, records_per_file: int = RECORDS) -> DataFrame:
    """Archives of `deduplicated` rows; the table (file, n_records, n_bytes) of those that were completed."""
    folder = scratch(records.sparkSession, "archives")
    columns = ["page_id", "url", "payload", "captured_us", "payload_digest", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        system.create_dir(base)
        sink, done = None, []
        for batch in batches:
            for page_id, url, payload, at, digested, refers in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if sink is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                sink.write(packer.compress(record(page_id, url, at, payload, digested, refers, refers is not None)) + packer.flush())
                count, size = count + 1, size + len(payload)
                if count >= records_per_file or size >= BYTES:
                    sink.close()
                    sink = None
                    done.append((f"{folder}/{name}", count, size))
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "n_records", "n_bytes"])

    return written(bounded(records.select(*columns)).mapInArrow(run, _FILES), "archived")


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an archive, read block by block."""
    system, name = _opened(path)
    with system.open_input_stream(name, compression=None) as source:
        start = at = 0
        unpack, parts, waiting = zlib.decompressobj(31), [], b""
        while True:
            waiting = waiting or source.read(_BLOCK)
            if not waiting:
                if at > start:
                    raise ValueError(f"{path} ends inside a record")
                return
            parts.append(unpack.decompress(waiting))
            at += len(waiting) - len(unpack.unused_data)
            waiting = unpack.unused_data
            if unpack.eof:
                yield start, at - start, b"".join(parts)
                start, unpack, parts = at, zlib.decompressobj(31), []


def _headers(text: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])


def parse(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; lengths that don't fit are refused."""
    head, rest = content.split(b"\r\n\r\n", 1)
    headers = _headers(head)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {headers['WARC-Record-ID']} does not have the length it states")
    http, payload = rest[:size].split(b"\r\n\r\n", 1)
    return headers, _headers(http), payload


def _id(name: str | None) -> int | None:
    found = (name or "")[10:-1]
    return int(found) if found else None


def captures(path: str) -> list[tuple]:
    """The index rows of one archive, as in CAPTURE; payloads are checked against their digests."""
    out = []
    for offset, length, content in members(path):
        headers, http, payload = parse(content)
        url, digested = headers.get("WARC-Target-URI", ""), headers["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = headers["WARC-Type"] == "revisit"
        if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digested:
            raise ValueError(f"record {headers['WARC-Record-ID']} does not have the digest it states")
        when = datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
        at = (when.days * 86_400 + when.seconds) * 1_000_000 + when.microseconds
        page, refers = _id(headers["WARC-Record-ID"]), _id(headers.get("WARC-Refers-To"))
        out.append((path, url_key(url), at, page, url, int(http["Content-Length"]), digested, headers["WARC-Type"], refers, offset, length))
    return out
