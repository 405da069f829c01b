"""WARC records in ZIP packages, written and read by ranges.

A written package holds the stored member `archive/data.warc.gz`, one gzip member per record, and the stored member
`indexes/index.cdx` with a line (offset, length) for each record. Reading takes two steps: one row per package, in which the
end record, the central directory (also in ZIP64 form) and the indexes are parsed, gives ranges of records; these are spread
over all tasks, and each is read from inside the stored member. Nothing is extracted, and a package larger than a
task's memory is read in pieces.

Packages of others may have any number of stored members `*.warc.gz` or `*.warc`, and any of them may lack an index, or have
one (lines of offset and length, or of JSON with filename, offset and length, plain or gzipped) that names only some
records: what no index names is scanned for records, a piece at a time, so none is lost. An archive that is compressed
inside the package, and an index that points elsewhere than to records, raise. Memory is that of the indexes, and of the
longest gzip member or record.

Files are written under unique names into a shared folder, and only names that a finished task has returned are read, so a
lost executor or a second attempt leaves nothing but an unused file.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.sources.shared import materialize, new_folder

PACKAGE_BYTES = 16_000_000
RANGE_BYTES = 1_000_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVES, INDEXES = re.compile(r"\.warc(\.gz)?$"), re.compile(r"(^|/)indexes/[^/]+\.cdxj?(\.gz)?$")
GZIP = b"\x1f\x8b"
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALL_16, ALL_32 = 0xFFFF, 0xFFFFFFFF


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# Records

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<{(uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}') if page is not None else uuid.uuid4()).urn}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit of the response with page id `refers_to`, which leaves the payload out."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)),
            ("WARC-Date", DATE), ("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c <= " " else c for c in url) if url else None),
            ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Page-Id", page)]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-Id", refers_to)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head if value is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and what follows the blank line. A line that starts with white space goes on."""
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode(errors="replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines)}, rest


def _sha1_of(field: str | None) -> str | None:
    """The SHA-1 that a digest field names, in base32 whether it is written so or in hex; None for other digests."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32encode(binascii.unhexlify(value)).decode() if len(value) == 40 else value.upper()


def parse_record(raw: bytes) -> dict:
    """The fields of a record; a payload that does not fit its SHA-1 raises.

    The payload of an HTTP response is what follows its head, as it was sent; that of any other record, but for revisits, which have
    none, is its block. payload_digest is computed where the record has none, and payload_bytes of a revisit is null where
    nothing tells it. A chunked payload is not compared with its digest, which may be that of the joined chunks.
    """
    if not raw.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head, rest = _headers(raw)
    block, kind = rest[:int(head["content-length"])], head["warc-type"].lower()
    http, payload, said = {}, block, _sha1_of(head.get("warc-payload-digest"))
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, payload = _headers(block)
    if kind == "revisit":
        size, digest, payload = http.get("content-length"), said, None
        size = int(size) if size and size.isdigit() else None
    else:
        size, digest = len(payload), base32_sha1(payload)
        if kind == "response" and said not in (None, digest) and "chunked" not in http.get("transfer-encoding", "").lower():
            raise ValueError(f"payload of {head.get('warc-record-id')} does not fit its digest")
    number = {n: int(head[k]) if k in head else None for n, k in (("page", "page-id"), ("refers_to", "refers-to-page-id"))}
    return {"page_id": number["page"], "url": head.get("warc-target-uri"), "payload": payload, "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": number["refers_to"]}


# Packages

def write_package(folder: str, records: list[bytes]) -> str:
    """Write compressed records and their index as one package; returns its path."""
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.zip"
    lines, at = [], 0
    for r in records:
        lines.append(f"{at} {len(r)}\n")
        at += len(r)
    with system.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
            for r in records:
                member.write(r)
        package.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
    return f"{folder}/{name}"


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    out = file.read(length)
    if len(out) != length:
        raise ValueError("the file ends early")
    return out


def directory(file, size: int) -> list[Member]:
    """Members from the central directory, whose place the end record, or its ZIP64 form, gives."""
    tail_at = max(0, size - 22 - ALL_16)
    tail = _range(file, tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP package")
        # A signature inside the comment is not followed by as long a comment as it says.
        if len(tail) - at >= 22 and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22:
            break
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if ALL_16 == count or ALL_32 in (length, start):
        if tail_at + at < 20:
            raise ValueError("no place for the ZIP64 locator")
        mark, _, end_at, _ = struct.unpack("<4sIQI", _range(file, tail_at + at - 20, 20))
        if mark == b"PK\x06\x07":
            end = _range(file, end_at, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
    central, out, p = _range(file, start, length), [], 0
    for _ in range(count):
        if central[p:p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", central, p + 10)
        stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, p + 20)
        header, = struct.unpack_from("<I", central, p + 42)
        name = central[p + 46:p + 46 + n_name].decode(errors="replace")
        extra = central[p + 46 + n_name:p + 46 + n_name + n_extra]
        plain, stored, header = _wide(extra, [plain, stored, header])
        out.append(Member(name, method, plain, stored, header))
        p += 46 + n_name + n_extra + n_comment
    return out


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Values that are all ones are in the ZIP64 field, in this order."""
    p = 0
    while p + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, p)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, p + 4))
            return [next(wide) if v == ALL_32 else v for v in values]
        p += 4 + n
    return values


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member start in the package."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = _range(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def _indexed(file, members: list[Member], archives: list[Member]) -> dict[str, list[tuple[int, int]]]:
    """(offset, length) of the records that stored indexes name, by archive."""
    found = defaultdict(list)
    for index in members:
        if index.method != 0 or not INDEXES.search(index.name):
            continue
        raw = _range(file, data_start(file, index), index.size)
        for line in (b"".join(_inflated(raw)) if raw.startswith(GZIP) else raw).decode(errors="replace").splitlines():
            if entry := _entry(line):
                name, at, length = entry
                named = [a.name for a in archives if name is None or f"/{a.name}".endswith(f"/{name}")]
                if len(named) == 1:
                    found[named[0]].append((at, length))
    return found


def _entry(line: str) -> tuple[str | None, int, int] | None:
    """Archive, offset and length in a line of an index; None for lines of other kinds, whose records a scan finds."""
    if "{" in line:
        try:
            values = json.loads(line[line.index("{"):])
            return values.get("filename"), int(values["offset"]), int(values["length"])
        except (ValueError, KeyError, TypeError):
            return None
    numbers = line.split()
    return (None, int(numbers[0]), int(numbers[1])) if len(numbers) == 2 and all(map(str.isdecimal, numbers)) else None


def _scanned(file, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the gzip members, or plain records, that fill a span, read piece by piece."""
    while start < end:
        zipped = _range(file, start, min(2, end - start)) == GZIP
        length = _member_length(file, start, end) if zipped else _record_length(file, start, end)
        yield start, length
        start += length


def _member_length(file, start: int, end: int) -> int:
    one, at = zlib.decompressobj(zlib.MAX_WBITS | 16), start
    while not one.eof:
        if at >= end:
            raise ValueError("a gzip member ends early")
        piece = _range(file, at, min(PIECE, end - at))
        at += len(piece)
        while piece and not one.eof:
            one.decompress(piece, PIECE)
            piece = one.unconsumed_tail
    return at - len(one.unused_data) - start


def _record_length(file, start: int, end: int) -> int:
    head = _range(file, start, min(PIECE, end - start))
    length = _plain_length(head, 0)
    if start + length > end:
        raise ValueError("a record ends early")
    # The line ends after a block belong to its record.
    rest = _range(file, start + length, min(4, end - start - length))
    return length + len(rest) - len(rest.lstrip(b"\r\n"))


def _plain_length(raw: bytes, at: int) -> int:
    """Bytes of head and block of the record that starts at `at`."""
    stop = raw.find(b"\r\n\r\n", at)
    if not raw.startswith(b"WARC/1.", at) or stop < 0:
        raise ValueError("not a WARC record")
    return stop + 4 - at + int(_headers(raw[at:stop])[0]["content-length"])


def _archive_records(file, archive: Member, indexed: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, length) in the package of everything in an archive, in order: as indexed, and scanned between."""
    base, at = data_start(file, archive), 0
    for start, length in sorted(set(indexed)):
        if start < at or length <= 0 or start + length > archive.size:
            continue
        yield from _scanned(file, base + at, base + start)
        yield base + start, length
        at = start + length
    yield from _scanned(file, base + at, base + archive.size)


def record_ranges(path: str, most: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) in the package of runs of whole records, of about `most` bytes or one longer record."""
    system, place = _open(path)
    with system.open_input_file(place) as file:
        members = directory(file, file.size())
        archives = [m for m in members if ARCHIVES.search(m.name)]
        indexed = _indexed(file, members, archives)
        for archive in archives:
            start = length = 0
            for at, n in _archive_records(file, archive, indexed[archive.name]):
                if length and length + n > most:
                    yield start, length
                    length = 0
                if not length:
                    start = at
                length += n
            if length:
                yield start, length


def _inflated(raw: bytes) -> Iterator[bytes]:
    while raw:
        one = zlib.decompressobj(zlib.MAX_WBITS | 16)
        yield one.decompress(raw) + one.flush()
        if not one.eof:
            raise ValueError("a gzip member ends early")
        raw = one.unused_data


def records_in(raw: bytes) -> Iterator[bytes]:
    """The records of a run, plain or in gzip members of one record or several."""
    for part in _inflated(raw) if raw.startswith(GZIP) else [raw]:
        at = 0
        while at < len(part):
            length = _plain_length(part, at)
            if at + length > len(part):
                raise ValueError("a record ends early")
            yield part[at:at + length]
            at += length
            while part[at:at + 1] in (b"\r", b"\n"):
                at += 1


def read_records(path: str, start: int, length: int) -> Iterator[dict]:
    system, place = _open(path)
    with system.open_input_file(place) as file:
        raw = _range(file, start, length)
    for one in records_in(raw):
        yield parse_record(one)


# Tables

def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (null html: empty) and refers_to: the largest page_id with an equal payload of at least
    `least` bytes, where that is another one.

    Rows that share the largest id are all responses. A row without page_id refers to the group's largest id, if any.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn(
        "digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    groups = rows.filter("digest is not null").groupBy("digest").agg(
        F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written, so that a payload that very many pages share is joined between plain shuffles and can be split.
    joined = rows.join(materialize(groups, "payloads"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("largest") > F.col("page_id")), F.col("largest"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row (page_id, url, payload, refers_to) into packages in `folder`: path and records of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([write_package(folder, held)]), pa.array([len(held)])], ["path", "records"])

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                pack = zlib.compressobj(4, zlib.DEFLATED, zlib.MAX_WBITS | 16)
                held.append(pack.compress(record(*values)) + pack.flush())
                size += len(held[-1])
                if size >= package_bytes:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return materialize(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long"), "packages")


FIELDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records, of every type, of the packages named in `path`: page_id and refers_to (null in archives of others), url,
    payload (null for revisits), payload_bytes, payload_digest, record_type. See `parse_record`."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = list(record_ranges(path, range_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *(
                    pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))], ["path", "start", "length"])

    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(read_records(*place))
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)], names)

    spread = max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = packages.select("path").repartition(spread, F.xxhash64("path")).mapInArrow(ranges, "path string, start long, length long")
    return placed.repartition(spread).mapInArrow(records, FIELDS)


def archive_pages(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages as WARC records in ZIP packages and read them back; extra columns of `pages` are ignored.

    Null html is an empty payload, null urls and page ids are left out of the record, and every row gives one record.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages, least), folder))


def digest_columns(records: DataFrame) -> list[Column]:
    return [records[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
