import gzip
import hashlib
import io
import os

from pyspark.sql import functions as F
from voxloom.llm.warc import _File, _member, _record, read, round_trip, salvage, sha1_base32, write

SCHEMA = "page_id long, url string, html string, path string, size long"
ROWS = [
    (1, "http://a", "<p>é</p>", "p", 1), (2, None, "<p>é</p>", "p", 1), (3, "http://c", None, None, None), (4, "http://d\r\nX: y", "", "p", 1),
    (5, "u", "x" * 300_000, "p", 1), (6, "u", "single WARC/1.1\r\n\r\n", "p", 1), (None, "u", "<p>é</p>", "p", 1), (7, "u", "x" * 300_000, "p", 1), (7, "u", "x" * 300_000, "p", 1),
]


def brute(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    out = []
    for i, p in data:
        best = max((j for j, q in data if q == p and j is not None), default=None)
        first = i is None or best == i or len(p) < least
        out.append((i, len(p), sha1_base32(p), "response" if first else "revisit", None if first else best))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for least in (0, 10):
        assert sorted(map(tuple, round_trip(df, min_bytes=least).collect()), key=repr) == brute(ROWS, least)
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def records(n):
    return [_record(i, f"http://h/{i}", f"payload {i} ".encode() * (50 + i), None) for i in range(n)]


def scan(data, step):
    file = _File(io.BytesIO(data), len(data))
    return [r for a in range(0, len(data), step) for r in salvage(file, a, min(a + step, len(data)))]


def check(data, step, lost, ids):
    rows = scan(data, step)
    assert [r["record_id"] for r in rows if not r["reason"]] == [f"<urn:page:{i}>" for i in ids]
    gaps = [(r["offset"], r["offset"] + r["length"]) for r in rows if r["reason"]]
    assert gaps == lost
    assert sum(r["length"] for r in rows) == len(data)


def test_salvage_members():
    members = [_member(r) for r in records(6)]
    ends = [sum(map(len, members[: i + 1])) for i in range(6)]
    data = b"".join(members)
    for step in (1 << 20, 100, 37):
        check(data, step, [], range(6))
        broken = bytearray(data)
        broken[ends[1] + 40] ^= 0xFF  # the third member fails its checksum
        check(bytes(broken), step, [(ends[1], ends[2])], [0, 1, 3, 4, 5])
        junk = data[: ends[2]] + b"\x1f\x8b\x08 junk \x1f\x8b" + data[ends[2] :]
        check(junk, step, [(ends[2], ends[2] + 11)], range(6))
        check(data[:-20], step, [(ends[4], len(data) - 20)], range(5))
        check(b"noise" + data, step, [(0, 5)], range(6))


def test_failed_digest_and_version_lines():
    plain = records(4)
    bad = plain[1].replace(b"payload 1 payload", b"payload 9 payload", 1)
    data = plain[0] + bad + plain[2] + plain[3]
    for step in (1 << 20, 500):
        check(data, step, [(len(plain[0]), len(plain[0]) + len(bad))], [0, 2, 3])
    packed = b"".join(map(_member, [plain[0], bad, plain[2]]))
    rows = scan(packed, 1 << 20)
    assert [r["reason"] for r in rows] == [None, "block digest", None]
    short = plain[0] + plain[1][:-30] + plain[2]
    check(short, 1 << 20, [(len(plain[0]), len(plain[0]) + len(plain[1]) - 30)], [0, 2])


def test_read_ranges_and_quarantine(spark, folder):
    df = spark.createDataFrame([(i, "u", f"text {i} " * 40) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = write(df, "page_id", "url", F.encode("html", "UTF-8"), folder)
    path = files.first().path
    with open(path, "rb") as f:
        data = bytearray(f.read())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    data[len(data) // 2] ^= 0x55
    with open(path, "wb") as f:
        f.write(data)
    rows = read(spark, files, range_bytes=1000).collect()
    assert sum(r.reason is None for r in rows) == 39 and sum(r.reason is not None for r in rows) == 1
    assert all(hashlib.sha1(r.payload).digest() for r in rows if r.payload)
    assert os.path.getsize(path) == sum(r.length for r in rows)
