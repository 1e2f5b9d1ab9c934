"""WARC archives in the shared folder: a writer, and a reader that salvages what it can of damaged files.

The writer puts each record into a gzip member of its own, in archives of about ``ARCHIVE_BYTES``, and returns a
manifest. Only files of the manifest count, so files that a lost task left behind are never read.

The reader cuts files into ranges; a record belongs to the range in which it starts. At each position it checks the member
(gzip header, checksum) or version line, the record header, the length and the digests. After a failed check it searches
for the next valid member or version line, goes on there, and logs the bytes between as a gap. One record is in
memory at a time. Uncompressed archives are read the same way, by version lines.

Defined cases: a null or empty payload is a record of 0 bytes; a null id is a response without an id header and never
revisits nor is revisited; rows that repeat the largest id of their payload are all responses; an empty table gives
one manifest without files and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from voxloom.session import fresh_path, stage

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
CHUNK = 1 << 18
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."  # fixed values
PAGE_URN = "urn:page:"
WRITE_SCHEMA = "path string, size long, records long"
READ_SCHEMA = (
    "path string, offset long, length long, reason string, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_bytes long, payload_digest string, payload binary"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One record; a revisit of ``response`` if that is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if response is not None else http + payload
    own = f"<{PAGE_URN}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {sha1_base32(payload)}')}>"
    fields = [
        ("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", own),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if response is not None:
        fields[1:1] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{PAGE_URN}{response}>"),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, id_col: str, url_col: str, payload: Column, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest (path, size, records), already written out.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest id is a response; the others revisit it.
    """
    body = F.coalesce(payload, F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "bytes": F.length("payload")})
    groups = rows.filter((F.col("bytes") >= min_bytes) & F.col("id").isNotNull()).groupBy("digest", "bytes")
    shared = groups.agg(F.count("*").alias("n"), F.max("id").alias("response")).filter("n > 1").drop("n")
    rows = rows.join(stage(shared, "shared-payloads"), ["digest", "bytes"], "left")
    first = F.col("response").isNull() | F.col("id").isNull() | (F.col("id") == F.col("response"))
    rows = rows.select("id", "url", "payload", F.when(~first, F.col("response")).alias("response"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out = [], None

        def finish():
            out.close()
            done.append((f"{folder}/{name}", size, records))

        for batch in batches:
            for page_id, url, data, response in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    name, size, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = _member(_record(page_id.as_py(), url.as_py(), data.as_py(), response.as_py()))
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= ARCHIVE_BYTES:
                    finish()
                    out = None
        if out is not None:
            finish()
        paths, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "size", "records"])

    return stage(rows.mapInArrow(archive, WRITE_SCHEMA), "manifest")


class _File:
    """Buffered reads at any position."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.buffer = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.buffer)):
            self.source.seek(at)
            self.at, self.buffer = at, self.source.read(min(max(n, 4 * CHUNK), self.size - at))
        return self.buffer[at - self.at : at - self.at + n]

    def find(self, needle: bytes, at: int) -> int:
        """First position of ``needle`` from ``at`` on; the size of the file if there is none."""
        while at < self.size:
            piece = self.read(at, min(CHUNK, self.size - at))
            found = piece.find(needle)
            if found >= 0:
                return at + found
            at += max(1, len(piece) - len(needle) + 1)
        return self.size


class Damaged(Exception):
    """A failed check; ``end`` is where the damaged record is known to end, if it is."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def _unpack(file: _File, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and its end."""
    if file.read(at, 3) != MAGIC:
        raise Damaged("no member")
    unpacker, parts, pos = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        piece = file.read(pos, min(CHUNK, file.size - pos))
        if not piece:
            raise Damaged("truncated member")
        try:
            parts.append(unpacker.decompress(piece))
        except zlib.error:
            raise Damaged("broken member") from None
        pos += len(piece)
    return b"".join(parts), pos - len(unpacker.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(VERSION.decode()):
        raise Damaged("no version line")
    pairs = (x.partition(":") for x in lines[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _length(fields: dict[str, str]) -> int:
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no length")
    return int(fields["content-length"])


def _checked(fields: dict[str, str], block: bytes) -> dict:
    """What a row needs of a record whose digests hold."""
    claimed = fields.get("warc-block-digest", "")
    if claimed.startswith("sha1:") and claimed[5:].upper() != sha1_base32(block):
        raise Damaged("block digest")
    kind, payload = fields.get("warc-type"), block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest, claimed = sha1_base32(payload), fields.get("warc-payload-digest", "")
    if kind == "revisit":
        payload, digest = None, claimed.removeprefix("sha1:").upper()
    elif claimed.startswith("sha1:") and claimed[5:].upper() != digest:
        raise Damaged("payload digest")
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"), "payload_bytes": None if payload is None else len(payload),
        "payload_digest": digest, "payload": payload,
    }


def _packed_record(file: _File, at: int) -> tuple[dict, int]:
    data, end = _unpack(file, at)
    try:
        head, gap, rest = data.partition(b"\r\n\r\n")
        fields = _fields(head)
        n = _length(fields)
        if not gap or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise Damaged("record length")
        return _checked(fields, rest[:n]), end
    except Damaged as found:
        raise Damaged(found.reason, end) from None


def _plain_record(file: _File, at: int) -> tuple[dict, int]:
    if file.read(at, len(VERSION)) != VERSION:
        raise Damaged("no version line")
    stop = file.find(b"\r\n\r\n", at)
    if stop >= file.size:
        raise Damaged("truncated record")
    fields = _fields(file.read(at, stop - at))
    n = _length(fields)
    end = stop + 4 + n + 4
    if end > file.size or file.read(end - 4, 4) != b"\r\n\r\n":
        raise Damaged("record length")
    return _checked(fields, file.read(stop + 4, n)), end


def salvage(file: _File, start: int, stop: int) -> Iterator[dict]:
    """Records that start in [start, stop), and the gaps that begin there or right after one of them."""
    packed = MAGIC in (file.read(0, 3), file.read(start, 3)) or file.find(VERSION, 0) >= file.size
    mark, parse = (MAGIC, _packed_record) if packed else (VERSION, _plain_record)

    def attempt(at: int):
        try:
            record, end = parse(file, at)
            return {"offset": at, "length": end - at, "reason": None, **record}, end, None
        except Damaged as found:
            return None, found.end, found.reason

    def following(at: int) -> int:
        while at < file.size:
            at = file.find(mark, at)
            if at >= file.size or attempt(at)[0]:
                return at
            at += 1
        return at

    at = start if start == 0 else following(start)
    while at < stop:
        row, end, reason = attempt(at)
        if row:
            yield row
            at = end
        else:
            goes_on = end if end is not None and (end >= file.size or attempt(end)[0]) else following(at + 1)
            yield {"offset": at, "length": goes_on - at, "reason": reason}
            at = goes_on
    if start < stop <= at < file.size and not attempt(at)[0]:  # the next range begins at its first valid record
        yield {"offset": at, "length": following(at + 1) - at, "reason": attempt(at)[2]}


def read(spark: SparkSession, files: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records and gaps (``reason`` not null) of ``files`` (path, size)."""
    starts = F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {int(range_bytes)}L)")).alias("start")
    ranges = stage(files.filter("size > 0").select("path", "size", starts), "ranges")
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.record_batch([pa.array([r.get(c) for r in rows], types.get(c, pa.string())) for c in names], names)

        for batch in batches:
            for item in batch.to_pylist():
                store, path = pyarrow.fs.FileSystem.from_uri(item["path"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for row in salvage(_File(source, item["size"]), item["start"], min(item["start"] + range_bytes, item["size"])):
                        row["path"] = item["path"]
                        held += len(row.get("payload") or b"") if with_payload else 0
                        rows.append(row if with_payload else row | {"payload": None})
                        if held > 4 << 20 or len(rows) >= 10000:
                            yield flush(rows)
                            rows, held = [], 0
                yield flush(rows)

    return ranges.repartition(max(1, ranges.count())).mapInArrow(parse, READ_SCHEMA)


def page_id(record_id: Column) -> Column:
    return F.regexp_extract(record_id, f"^<{PAGE_URN}(-?[0-9]+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    files = write(pages, id_col, url_col, F.encode(F.col(text_col), "UTF-8"), fresh_path(spark, "warc"), min_bytes)
    records = stage(read(spark, files, with_payload=False), "records")
    found = records.filter("reason IS NULL").select(
        page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id(F.col("refers_to")).alias("refers_to"),
    )
    used = found.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    sizes = found.filter("record_type = 'response'").join(used, "page_id", "left_semi")
    sizes = sizes.groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    on = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    linked = found.join(sizes, on, "left")
    return linked.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
