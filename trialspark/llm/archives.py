"""Legacy ARC archives and their conversion to WARC.

ARC files hold a version block, which names the fields of the header lines that
follow, and records of a declared length.  The converter reads header lines by
their version, cuts blocks by their length and writes WARC records with
synthesised identifiers, dates, types and digests; records whose payload
repeats an earlier one become revisits.

Archives are plain files in the shared folder, written by Spark's text writer
(records are valid UTF-8; the separator between records is the line separator)
with gzip, and read by Spark's binary reader.  Each file holds ``PER_FILE``
records, so a task holds one bounded file at a time.  Which record comes first
is decided on digests alone: payloads are never shuffled by digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import keep, map_arrow
from trialspark.sources.ingest import scratch_path

PER_FILE = 500
#: Bytes of records beyond which a file is closed.
FILE_BYTES = 64 << 20
#: Header fields by ARC version (fixed values).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    """Base32 SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str | None) -> str:
    """A URL as one header field: white space and control characters are escaped."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-") or "-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    name = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{name}\r\n".encode() + payload


def arc_version_block(version: int, name: str) -> bytes:
    block = f"{version} 0 trialspark\n{' '.join(FIELDS[version])}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Result-code": "200",
            "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + block


def arc_record(version: int, url: str | None, block: bytes, date: str = DATE, ip: str = "0.0.0.0") -> bytes:
    line = {"URL": _clean(url), "IP-address": ip, "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-",
            "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(block))}
    return " ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + block


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    block: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version blocks not among them.

    Lines that are empty between records are skipped.  A header line without the
    fields of its version, or a length beyond the file, ends the reading with
    ValueError.
    """
    at, names = 0, FIELDS[1]
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at: stop if stop >= 0 else len(data)]
        if not line.strip():
            at += len(line) + 1
            continue
        new = line.startswith(b"filedesc://")
        if new:  # its own line may be of either version
            names = FIELDS[2] if line.count(b" ") == len(FIELDS[2]) - 1 else FIELDS[1]
        values = line.decode(errors="replace").rstrip("\r").rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        begin, size = at + len(line) + 1, int(values[-1])
        if begin + size > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        block = data[begin: begin + size]
        if new:
            named = block.split(b"\n")[1].decode().split() if block.count(b"\n") > 1 else ()
            names = tuple(named) or FIELDS[2 if block.startswith(b"2 ") else 1]
        else:
            yield ArcRecord(at, dict(zip(names, values, strict=True)), block)
        at = begin + size


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), header bytes and payload of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode(errors="replace").split("\r\n")[1:] if ": " in x)
    return {k.lower(): v for k, v in fields.items()}, head + b"\r\n\r\n", payload


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, key)}>"


def warc_record(kind: str, key: str, url: str, date: str, ip: str, head: bytes, payload: bytes, digest: str, refers_to: tuple[str, int | None] | None = None) -> bytes:
    """A WARC 1.1 record; its id comes from ``key``, the place of its source.  A
    revisit keeps the HTTP header only and names the key and page it refers to."""
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {iso(date)}", f"WARC-Target-URI: {url}",
             f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to[0])}", f"X-Refers-To-Page: {refers_to[1]}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_info(name: str) -> bytes:
    block = b"software: trialspark\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {iso(DATE)}", "Content-Type: application/warc-fields",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def iso(date: str) -> str:
    """A 14-digit ARC date as WARC writes it; missing digits count as the earliest."""
    d = date if date.isdigit() else DATE
    d = d[:14] + "00000101000000"[len(d[:14]):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each WARC record."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or stop < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])}
        begin, size = stop + 4, int(fields["content-length"])
        if begin + size > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[begin: begin + size]
        at = begin + size


def unzip(data: bytes) -> bytes:
    """Content of a gzip file of one or more members, or of a plain file."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) if out else data


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """One file per row."""
    rows.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _gather(rows: Iterator, first: Callable[[int], bytes], separator: bytes, record_of: Callable, size_of: Callable[[object], int],
            limits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Files within ``limits`` (records, and bytes if there is more than one record), each
    with its first record; one value holds a file, and a task one file."""
    made, out, size = 0, [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([separator.join(out)], pa.binary()).cast(pa.string())], names=["value"])

    for row in rows:
        if out and (len(out) > limits[0] or size + size_of(row) > limits[1]):
            yield close()
            out, size = [], 0
        if not out:
            out.append(first(made))
            made += 1
        out.append(record_of(row))
        size += len(out[-1])
    if out:
        yield close()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """ARC files of all pages; versions 1 and 2 in turn, file by file.  A null page is empty."""
    limits = (PER_FILE, FILE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 2

        def begin(made: int) -> bytes:
            nonlocal version
            version = 1 + made % 2
            return arc_version_block(version, f"part-{made}.arc")

        def records() -> Iterator[tuple[int | None, str | None, bytes]]:
            for batch in batches:
                for i, u, h in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                    yield (i, u, (h.as_py() or "").encode())

        yield from _gather(records(), begin, b"\n", lambda r: arc_record(version, r[1], http_block(r[0], r[2])), lambda r: len(r[2]), limits)

    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    _write(slim.mapInArrow(run, "value string"), path, "\n")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, page_id, digest, bytes): payloads of the records of ARC files."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
            out: list[list] = [[], [], [], [], []]
            for r in read_arc(unzip(content.as_py())):
                fields, _, payload = split_http(r.block)
                page = int(fields["x-page-id"]) if "x-page-id" in fields else None
                for o, v in zip(out, (name.as_py(), r.offset, page, digest_of(payload), len(payload)), strict=True):
                    o.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["path", "offset", "page_id", "digest", "bytes"])

    return map_arrow(_files(spark, path), run, "path string, offset long, page_id long, digest string, bytes long")


def arc_to_warc(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """Convert ARC files to WARC files.

    Of records with equal payloads of at least ``least`` bytes, the one with the
    smallest page id (records without an id come last, repeated ids in file
    order) is a response, the others revisit it; other records are responses.
    """
    limits = (PER_FILE, FILE_BYTES)
    index = keep(arc_index(spark, arc), "arc-index")
    first = (index.where(F.col("bytes") >= least).groupBy("digest", "bytes")
             .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset")).alias("first"), F.count(F.lit(1)).alias("k"))
             .where("k > 1"))
    again = (index.join(first, ["digest", "bytes"]).where("path <> first.path OR offset <> first.offset")
             .groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("offset", F.struct(F.col("first.page_id").alias("page"), F.col("first.path").alias("path"), F.col("first.offset").alias("at"))))).alias("again")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = ""

        def begin(made: int) -> bytes:
            return warc_info(f"{source}#{made}")

        def records() -> Iterator[tuple[str, dict, ArcRecord]]:
            nonlocal source
            for batch in batches:
                for name, content, again in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("again"), strict=True):
                    source, met = name, dict(again.as_py() or [])
                    for r in read_arc(unzip(content.as_py())):
                        yield name, met, r

        def converted(row: tuple[str, dict, ArcRecord]) -> bytes:
            name, met, r = row
            _, head, payload = split_http(r.block)
            kind, to = ("revisit", met[r.offset]) if r.offset in met else ("response", None)
            return warc_record(kind, f"{name}:{r.offset}", r.fields["URL"], r.fields["Archive-date"], r.fields["IP-address"], head, payload, digest_of(payload),
                               None if to is None else (f"{to['path']}:{to['at']}", to["page"]))

        yield from _gather(records(), begin, b"\r\n\r\n", converted, lambda row: len(row[2].block), limits)

    files = _files(spark, arc).join(keep(again, "revisits"), "path", "left")
    _write(files.mapInArrow(run, "value string"), warc, "\r\n\r\n")


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records of WARC files.

    The digest of a response is computed from its payload and must equal the
    one it declares; size and digest of a revisit are those it declares.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column("content"):
            out: list[list] = [[], [], [], [], [], []]
            for fields, block in read_warc(unzip(content.as_py())):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                http, _, payload = split_http(block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"wrong digest of {fields['warc-record-id']}")
                size = int(http["content-length"]) if kind == "revisit" else len(payload)
                page, to = http.get("x-page-id"), fields.get("x-refers-to-page", "None")
                for o, v in zip(out, (None if page is None else int(page), fields["warc-target-uri"], size, digest, kind, None if to == "None" else int(to)), strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)],
                                             names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return map_arrow(_files(spark, path), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Pages through ARC files, the converter and WARC files: what the WARC files hold.

    One row per row of ``pages``; null or empty pages have an empty payload,
    null ids stay null.  Other columns are not read.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, page_id, url, html)
    arc_to_warc(spark, arc, warc, least)
    _discard(spark, arc)
    return read_warc_files(spark, warc)
