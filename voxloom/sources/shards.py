"""Tar shards of any store as a table of samples.

Two readers give the same rows. On a mounted path a Python data source opens the tars; a large plain tar is shared by tasks by
byte ranges, and each finds its first header by the checksum. On any other store Spark's own text reader brings the bytes: it cuts a file at the
word that every tar header holds, in byte ranges, and hands over what lies between unchanged. What a range cannot decide, the samples
at its two ends, is put together per file from the pieces of neighbouring ranges.

Shards of a commit that has not ended are left out (:mod:`voxloom.sources.store`).
"""

from __future__ import annotations

import glob
import os
import re
import tarfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.sources.store import COMMITS, Store, hidden
from voxloom.sources.tars import BLOCK, MAGIC, TarSamples, header, sample_name

FORMAT = "voxshards"
READ_DDL = "shard string, key string, members map<string,binary>"
FLUSH_BYTES = 32 << 20
SPLIT_BYTES = 1 << 30
READ_BYTES = 4 << 20
PACK_BYTES = 128 << 20  # of small tars that one task reads, each counted as OPEN_BYTES more
OPEN_BYTES = 1 << 20
_RANGE = re.compile(r"\{(\d+)\.\.(\d+)\}")
_ARROW = pa.schema(
    [("shard", pa.string()), ("key", pa.string()), ("members", pa.map_(pa.string(), pa.binary()))]
)


def mounted(path: str) -> str | None:
    """A plain path for the file system of this machine; None for any other store."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return "/" + rest.lstrip("/")
    return None if colon and rest.startswith("//") else path


def numbered_paths(pattern: str) -> list[str]:
    """The paths of every ``{000000..000010}`` range of a pattern, in the order given."""
    found = _RANGE.search(pattern)
    if not found:
        return [pattern]
    low, high = found.groups()
    numbers = range(int(low), int(high) + 1)
    paths = [pattern[: found.start()] + str(i).zfill(len(low)) + pattern[found.end() :] for i in numbers]
    return [p for one in paths for p in numbered_paths(one)]


def expand_shards(pattern: str) -> list[str]:
    """Sorted tar paths of a glob on this machine, or of a ``{000000..000010}`` range in the order given."""
    plain = mounted(pattern)
    if plain is None:
        raise ValueError(f"{pattern} is not mounted; see list_shards")
    listed = []
    for one in numbered_paths(plain):
        found = sorted(glob.glob(one)) if glob.has_magic(one) else [one]
        if not found:
            raise FileNotFoundError(f"no shard matches {one}")
        listed += found
    return listed


def list_shards(spark: SparkSession, pattern: str) -> list[str]:
    """The tars of a pattern in any store, without those of commits that have not ended."""
    if mounted(pattern) is not None:
        paths = expand_shards(pattern)
    else:
        store, paths = Store(spark, pattern), []
        for one in numbered_paths(pattern):
            found = store.glob(one) if glob.has_magic(one) else [one]
            if not found:
                raise FileNotFoundError(f"no shard matches {one}")
            paths += found
    return visible(spark, paths)


def visible(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths ``<folder>/<split>/<shard>`` less those that a commit in ``folder`` lists and has not ended."""
    kept, known = [], {}
    for path in paths:
        folder = path.rsplit("/", 2)[0] if path.count("/") > 1 else "."
        if folder not in known:
            at = mounted(folder)
            there = os.path.isdir(f"{at}/{COMMITS}") if at is not None else True
            known[folder] = hidden(Store(spark, folder), folder) if there else set()
        if path[len(folder) + 1 :] not in known[folder]:
            kept.append(path)
    return kept


# -- mounted paths -------------------------------------------------------------------------------


@dataclass
class ShardPartition(InputPartition):
    """The samples of a tar that bytes ``start`` to ``end`` decide; ``end`` is None for the whole of it."""

    path: str
    start: int
    end: int | None


@dataclass
class PackedPartition(InputPartition):
    """The shares of a task: one of a large tar, or some small tars one after the other."""

    shares: list[ShardPartition]


def _packed(shares: Sequence[tuple[ShardPartition, int]], tasks: int) -> list[InputPartition]:
    """Shares and their bytes, as :func:`_partitions` cuts them, dealt in their order to tasks of bounded size, and to ``tasks`` at least where they suffice."""
    total = sum(size + OPEN_BYTES for _, size in shares)
    most = min(PACK_BYTES, max(OPEN_BYTES, total // max(tasks, 1)))
    packs, held = [], most
    for share, size in shares:
        if held + size + OPEN_BYTES > most:
            packs.append(PackedPartition([]))
            held = 0
        packs[-1].shares.append(share)
        held += size + OPEN_BYTES
    return packs


def _is_plain(path: str) -> bool:
    with open(path, "rb") as file:
        return header(file.read(BLOCK)) is not None


def _partitions(path: str, split_bytes: int) -> list[tuple[ShardPartition, int]]:
    """Shares of a tar and their bytes. Only an uncompressed tar can be shared. Its first header tells, not its name."""
    size = os.path.getsize(path)
    if size <= split_bytes or not _is_plain(path):
        return [(ShardPartition(path, 0, None), size)]
    return [(ShardPartition(path, at, at + split_bytes), min(split_bytes, size - at)) for at in range(0, size, split_bytes)]


def _whole(path: str) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Adjacent members of one key, of a tar of any compression."""
    key, members = None, {}
    with tarfile.open(path, "r|*") as tar:
        for member in tar:
            named = sample_name(member.name) if member.isfile() else None
            if named is not None:
                if named[0] != key:
                    if members:
                        yield key, members
                    key, members = named[0], {}
                members[named[1]] = tar.extractfile(member).read()
            tar.members = []  # headers seen are not kept
    if members:
        yield key, members


def _shared(share: ShardPartition) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Samples that begin after the second header at or beyond ``start``, up to the second at or beyond ``end``.

    A reader that begins inside a tar knows no key before that of the second member, so that is where shares meet.
    """
    parser = TarSamples(share.start == 0, share.end - share.start)

    def of_the_next(offset: int) -> bool:
        return len(parser.beyond) == 2 and offset > parser.beyond[1]

    with open(share.path, "rb") as file:
        file.seek(share.start)
        piece = b"-"
        while piece:
            piece = file.read(READ_BYTES)
            for offset, key, members in parser.feed(piece) if piece else parser.finish():
                if of_the_next(offset):
                    return
                yield key, members
            if parser.key is not None and of_the_next(parser.begin):
                return


class ShardReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], split_bytes: int = SPLIT_BYTES, tasks: int = 1):
        self.paths, self.split_bytes, self.tasks = paths, split_bytes, tasks

    def partitions(self) -> list[InputPartition]:
        return _packed([p for path in self.paths for p in _partitions(path, self.split_bytes)], self.tasks)

    def read(self, partition: PackedPartition) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for share in partition.shares:
                shard = os.path.basename(share.path)
                for key, members in _whole(share.path) if share.end is None else _shared(share):
                    yield shard, key, members

        return _batched(rows(), _ARROW)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; the last column holds the members, or another value of bytes."""
    held, size = [], 0
    for row in rows:
        held.append(tuple(list(v.items()) if isinstance(v, dict) else v for v in row))
        size += sum(sum(map(len, v.values())) if isinstance(v, dict) else len(v) for v in row if isinstance(v, dict | bytes))
        if size >= FLUSH_BYTES:
            yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ_DDL

    def reader(self, schema) -> DataSourceReader:
        listed = self.options.get("paths")
        paths = listed.split("\n") if listed else expand_shards(self.options["path"])
        return ShardReader(paths, int(self.options.get("splitBytes", SPLIT_BYTES)), int(self.options.get("tasks", 1)))


# -- any other store -----------------------------------------------------------------------------

_PIECES = "path string, start long, part int, bytes binary"
_PIECES_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("bytes", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, TarSamples, Iterator]]:
    """(path, start, whether it is all of the file, parser, samples) of every byte range of a task."""
    for (path, start, whole), records in groupby(_records(batches), key=lambda r: r[:3]):
        parser = TarSamples(start == 0)

        def samples(records=records, parser=parser):
            joint = b""
            for *_, value in records:
                yield from parser.feed(joint + bytes(value))
                joint = MAGIC

        yield path, start, whole, parser, samples()


def _inner_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples that lie inside a byte range."""

    def rows() -> Iterator[tuple]:
        for path, _, whole, parser, samples in _ranges(batches):
            shard = path.rpartition("/")[2]
            for _, key, members in samples:
                yield shard, key, members
            for _, key, members in parser.finish() if whole else ():
                yield shard, key, members

    return _batched(rows(), _ARROW)


def _edge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a byte range leaves to its neighbours: the bytes before its first and from its last change of key."""

    def rows() -> Iterator[tuple]:
        for path, start, _, parser, samples in _ranges(batches):
            for _ in samples:
                pass
            if parser.lead is None:
                yield path, start, 0, bytes(parser.held)  # no change of key here: all of it
                continue
            if start > 0:
                yield path, start, 0, parser.lead
            yield path, start, 1, bytes(parser.held)

    return _batched(rows(), _PIECES_ARROW)


def _edge_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of a file's pieces, which come in order."""

    def rows() -> Iterator[tuple]:
        for path, pieces in groupby(_records(batches), key=lambda r: r[0]):
            shard, parser = path.rpartition("/")[2], None
            for _, _, part, value in pieces:
                if part == 1 and parser is not None:
                    yield from ((shard, key, members) for _, key, members in parser.finish())
                joint = b"" if part == 1 or parser is None else MAGIC
                parser = TarSamples(True) if part == 1 or parser is None else parser
                yield from ((shard, key, members) for _, key, members in parser.feed(joint + bytes(value)))
            yield from ((shard, key, members) for _, key, members in parser.finish())

    return _batched(rows(), _ARROW)


def read_stored_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The samples of plain tars in any store, by Spark's text reader; a split of it is a byte range.

    Files of more than one split are read a second time for the few samples at the ends of ranges, so that nothing is staged.
    """
    text = spark.read.format("text").option("lineSep", MAGIC.decode()).load(list(paths))
    meta = lambda name: F.col(f"_metadata.{name}")
    whole = (meta("file_block_start") == 0) & (meta("file_block_length") == meta("file_size"))
    records = text.select(meta("file_path").alias("path"), meta("file_block_start").alias("start"), whole.alias("whole"), F.col("value").cast("binary").alias("value"))
    inner = records.mapInArrow(_inner_samples, READ_DDL)
    edges = records.where(~F.col("whole")).mapInArrow(_edge_pieces, _PIECES)
    joined = edges.repartition("path").sortWithinPartitions("path", "start", "part").mapInArrow(_edge_samples, READ_DDL)
    lengths = spark.read.format("binaryFile").load(list(paths)).select("length")
    conf = spark._jsparkSession.sessionState().conf()
    least = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())  # Spark cuts no file of this size
    if (lengths.agg(F.max("length")).first()[0] or 0) <= least:
        return inner
    return inner.unionByName(joined)


def read_shards(
    spark: SparkSession, pattern: str | Sequence[str], split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(shard, key, members) of every sample in the tars that a pattern or a list of paths names."""
    paths = list_shards(spark, pattern) if isinstance(pattern, str) else visible(spark, pattern)
    if not paths:  # none yet, or none that is committed
        return spark.createDataFrame([], READ_DDL)
    if any(mounted(p) is None for p in paths):
        return read_stored_shards(spark, paths)
    spark.dataSource.register(ShardSource)
    reader = spark.read.format(FORMAT).option("splitBytes", split_bytes).option("tasks", spark.sparkContext.defaultParallelism)
    return reader.option("paths", "\n".join(mounted(p) for p in paths)).load()
