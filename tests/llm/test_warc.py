import base64
import hashlib
import io
import random
import struct
import zipfile
import zlib
from collections import Counter

import pytest

from packhouse.llm import warc

ROWS = "page_id long, url string, html string, payload string"


def pages():
    pick = random.Random(1)
    bodies = [None, "", "<p>x</p>", "é" * 9, "<html>\r\n\r\nWARC/1.1\r\n</html>", "y" * 300_000] + [f"<p>{i}</p>" for i in range(9)]
    rows = [(i, f"http://a/{i}?é b\n", pick.choice(bodies), "z") for i in range(120)]
    return rows + [(None, None, "<p>x</p>", "z"), (None, "u", "alone", "z"), (500, None, "twice", "z"), (500, None, "twice", "z")]


def brute(rows, least):
    out = Counter()
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in rows if p is not None and (h or "").encode() == payload]
        largest = max(same, default=None) if len(payload) >= least else None
        refers = largest if largest is not None and (page is None or page < largest) else None
        out[page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "response" if refers is None else "revisit", refers] += 1
    return out


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    packages = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, ROWS), least), f"file://{tmp_path}", 50_000)
    read = warc.read_archives(packages, 2_000)
    assert packages.count() > 1 and packages.groupBy().sum("records").first()[0] == len(rows)
    assert Counter(tuple(r) for r in read.select(*warc.digest_columns(read)).collect()) == brute(rows, least)
    texts = {p: (h or "").encode() for p, _, h, _ in rows}
    for r in read.filter("payload is not null").collect():
        assert r.page_id is None or bytes(r.payload) == texts[r.page_id]
        assert r.page_id is None or r.page_id == 500 or r.url == f"http://a/{r.page_id}?é%20b%0A"


def test_empty_table(spark, tmp_path):
    assert warc.archive_pages(spark.createDataFrame([], ROWS), folder=str(tmp_path)).collect() == []


def test_packages_are_plain_zip_and_gzip_files(tmp_path):
    raw = [zlib.compress(warc.record(i, "u", b"x" * i, None), wbits=31) for i in range(5)]
    path = warc.write_package(str(tmp_path), raw)
    with zipfile.ZipFile(path) as package:
        assert package.testzip() is None and package.namelist() == [warc.ARCHIVE, warc.INDEX]
        assert zlib.decompress(package.read(warc.ARCHIVE)[:len(raw[0])], 31).startswith(b"WARC/1.1\r\nWARC-Type: response")
    whole = open(path, "rb").read()
    assert [whole[s:s + n] for s, n in warc.record_ranges(path, 1)] == raw
    assert [whole[s:s + n] for s, n in warc.record_ranges(path)] == [b"".join(raw)]


def zip64(body):
    """A package whose every place and size is in ZIP64 form, with a comment that looks like an end record."""
    ones = 0xFFFFFFFF
    crc = zlib.crc32(body)
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, crc, ones, ones, 1, 20) + b"m"
    local += struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHH", 9, 2, 7) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 4)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, crc, ones, ones, 1, len(extra), 0, 0, 0, 0, ones)
    central += b"m" + extra
    start = 4 + len(local) + len(body)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    comment = b"PK\x05\x06" + b"c" * 40
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", ALL, ALL, ALL, ALL, ones, ones, len(comment)) + comment
    return b"junk" + local + body + central + end + locator + last


ALL = 0xFFFF


def test_zip64_directories_and_comments():
    raw = zip64(b"some stored bytes")
    file = io.BytesIO(raw)
    (member,) = warc.directory(file, len(raw))
    start = warc.data_start(file, member)
    assert member.name == "m" and raw[start:start + member.size] == b"some stored bytes"


@pytest.mark.parametrize("raw", [b"", b"x" * 100, zip64(b"y")[:-60], b"PK\x05\x06" + b"\xff" * 16 + b"\0\0"])
def test_broken_packages_raise(raw):
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(raw), len(raw))


def test_compressed_archives_and_changed_payloads_raise():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("m", "x" * 100)
    (member,) = warc.directory(out, len(out.getvalue()))
    with pytest.raises(ValueError, match="not stored"):
        warc.data_start(out, member)
    raw = warc.record(1, None, b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"payload\r\n", b"Payload\r\n"))
    with pytest.raises(ValueError, match="not a WARC"):
        warc.parse_record(b"other")


def member(kind, block=b"", **fields):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x>", **{k.replace("_", "-"): v for k, v in fields.items()}}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return f"WARC/1.0\r\n{head}Content-Length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nX: a\r\n b\r\n\r\n"


def foreign(folder, name, members):
    with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_STORED) as package:
        for where, raw in members:
            package.writestr(where, raw)
    return f"{folder}/{name}"


def read_foreign(path, most=1 << 20):
    return [r for s, n in warc.record_ranges(path, most) for r in warc.read_records(path, s, n)]


RECORDS = [member("warcinfo", b"software: x"), member("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/"),
           member("response", HTTP + b"one", WARC_Target_URI="http://a/"),
           member("revisit", b"", WARC_Payload_Digest="sha1:" + "A" * 32), member("response", b"dns text"), member("metadata")]
WANT = [("warcinfo", b"software: x", 11), ("request", b"GET / HTTP/1.1\r\n\r\n", 18), ("response", b"one", 3),
        ("revisit", None, None), ("response", b"dns text", 8), ("metadata", b"", 0)]


def seen(records):
    return [(r["record_type"], r["payload"], r["payload_bytes"]) for r in records]


@pytest.mark.parametrize("most", [1, 1 << 20])
@pytest.mark.parametrize("index", ["none", "some", "gzipped", "wrong name", "old kind"])
def test_packages_of_others(tmp_path, index, most):
    packed = [zlib.compress(r, wbits=31) for r in RECORDS]
    at = sum(map(len, packed[:2]))
    line = 'com,a)/ 2024 {"url": "http://a/", "filename": "%s", "offset": "%d", "length": "%d"}\n' % (
        "z.warc.gz" if index == "wrong name" else "b.warc.gz", at, len(packed[2]))
    lines = {"none": "", "some": line, "gzipped": line, "wrong name": line, "old kind": " CDX N b a\ncom,a)/ 2024 http://a/ - 200 A - 5 b\n"}[index]
    name = "indexes/index.cdx.gz" if index == "gzipped" else "indexes/index.cdxj"
    raw = zlib.compress(lines.encode(), wbits=31) if index == "gzipped" else lines.encode()
    path = foreign(tmp_path, "x.wacz", [
        ("archive/a.warc", b"".join(RECORDS)), ("datapackage.json", b"{}"), ("archive/b.warc.gz", b"".join(packed)),
        *([(name, raw)] if index != "none" else []), ("more/one.warc.gz", zlib.compress(b"".join(RECORDS), wbits=31)),
        ("archive/empty.warc.gz", b"")])
    assert seen(read_foreign(path, most)) == WANT * 3


def test_packages_of_others_on_spark(spark, tmp_path):
    body = b"y" * 3_000_000
    long = member("response", HTTP + body, WARC_Payload_Digest=f"sha1:{hashlib.sha1(body).hexdigest()}")
    paths = [foreign(tmp_path, f"{i}.zip", [("archive/a.warc", b"".join(RECORDS)), ("archive/b.warc.gz", zlib.compress(long, wbits=31)),
                                            ("archive/c.warc", long + RECORDS[0])]) for i in range(3)]
    rows = warc.read_archives(spark.createDataFrame([(p,) for p in paths], "path string"), 100).collect()
    assert Counter((r.record_type, r.payload_bytes) for r in rows) == Counter(
        {**{(k, n): 3 for k, _, n in WANT}, ("warcinfo", 11): 6, ("response", len(body)): 6})
    assert {r.payload_digest for r in rows if r.payload_bytes == len(body)} == {base64.b32encode(hashlib.sha1(body).digest()).decode()}


def test_damaged_archives_raise(tmp_path):
    packed = zlib.compress(RECORDS[2], wbits=31)
    for name, raw in [("a.warc.gz", packed[:-9]), ("b.warc", RECORDS[2][:-20]), ("c.warc", b"text"), ("d.warc.gz", packed + b"junk")]:
        with pytest.raises((ValueError, zlib.error)):
            read_foreign(foreign(tmp_path, f"{name}.zip", [(name, raw)]))
    moved = foreign(tmp_path, "moved.zip", [("archive/a.warc.gz", packed * 2), ("indexes/index.cdx", f"3 {len(packed)}\n".encode())])
    with pytest.raises((ValueError, zlib.error)):
        read_foreign(moved)


def test_chunked_payloads_and_other_digests_pass():
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\none\r\n0\r\n\r\n"
    said = "sha1:" + base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    assert warc.parse_record(member("response", chunked, WARC_Payload_Digest=said))["payload"].startswith(b"3\r\n")
    found = warc.parse_record(member("response", HTTP + b"one", WARC_Payload_Digest="sha256:" + "0" * 64))
    assert found["payload_digest"] == warc.base32_sha1(b"one")
