"""Write keyed samples as tar shards to any store that Spark can write to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.order import SHARD_SIZE, assign_keys, assign_shards
from voxloom.operators.scan import value_block
from voxloom.sources.store import Store, commit, pending
from voxloom.sources.tars import BLOCK, member_bytes

LINES_DDL = "split string, shard string, n long, line binary"
_LINES = pa.schema([("split", pa.string()), ("shard", pa.string()), ("n", pa.int64()), ("line", pa.binary())])
_BATCH_BYTES = 16 << 20
_END = bytes(2 * BLOCK)


def _tar_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each shard, cut where a zero byte can stand for the end of a line.

    Every header ends in zeros, and so does the archive: a line is the data of a member and the next header but for its last byte.
    """
    held, size = [], 0
    rows = (row for batch in batches for row in batch.to_pylist())
    for (split, shard), samples in groupby(rows, key=lambda r: (r["split"], r["shard"])):
        n, before = 0, b""
        for sample in samples:
            for ext, data in sample["members"]:
                head, body = member_bytes(f"{sample['key']}.{ext}", data)
                held.append((split, shard, n, before + head[:-1]))
                n, before, size = n + 1, body, size + len(before) + len(head)
                if size >= _BATCH_BYTES:
                    yield pa.record_batch([list(c) for c in zip(*held)], schema=_LINES)
                    held, size = [], 0
        held.append((split, shard, n, before + _END[:-1]))
    if held:
        yield pa.record_batch([list(c) for c in zip(*held)], schema=_LINES)


def write_shards(df: DataFrame, folder: str, replace: bool = False) -> None:
    """Write ``df(split, shard, key, members)`` to ``<folder>/<split>/<shard>``.

    Spark's text writer, with a zero byte for the end of a line, writes the bytes of each tar below a hidden folder. The finished
    tars are then put in place by one journalled commit: either readers see all of them or none. A shard that exists already
    stops the write before any shard is put in place, unless ``replace`` is set.

    A shard is one task's work and has a fixed number of samples, so no task grows with the data.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    store = Store(spark, folder)
    if pending(store, folder):
        raise RuntimeError(f"a commit in {folder} has not ended; recover it first")
    staged = f"_staged-{uuid.uuid4().hex}"
    rows = df.select("split", "shard", "key", "members").repartition("split", "shard").sortWithinPartitions("split", "shard", "key")
    lines = rows.mapInArrow(_tar_lines, LINES_DDL)
    # Sorted as the writer wants it, so that it does not sort again and lose the order of lines.
    ordered = lines.sortWithinPartitions("split", "shard", "n")
    text = ordered.select("split", "shard", F.col("line").cast("string").alias("value"))
    text.write.partitionBy("split", "shard").option("lineSep", "\0").text(f"{folder}/{staged}")
    root = store.qualified(f"{folder}/{staged}")
    written = spark.read.format("text").option("recursiveFileLookup", True).load(f"{folder}/{staged}").inputFiles()
    moves = {}
    for path in written:
        inner = path[path.index(staged) + len(staged) + 1 :]
        split, shard = (unquote(part.partition("=")[2]) for part in unquote(inner).split("/")[:2])
        if (split, shard) in moves:
            store.delete(root)
            raise ValueError(f"{split}/{shard} was written by two tasks; cluster the rows by (split, shard)")
        moves[split, shard] = f"{staged}/{unquote(inner)}"
    if not replace:
        there = [f"{s}/{n}" for s in sorted({s for s, _ in moves}) for n in store.names(f"{folder}/{s}") if (s, n) in moves]
        if there:
            store.delete(root)
            raise FileExistsError(f"{len(there)} shards exist already, the first is {there[0]}")
    if moves:
        commit(store, folder, [(old, f"{split}/{shard}") for (split, shard), old in sorted(moves.items())])
    store.delete(root)


def drop_shards_from(spark: SparkSession, folder: str, first: dict[str, int]) -> None:
    """Remove the shards of each split from a number on: no ledger names them, a run that died has left them."""
    store = Store(spark, folder)
    for split, idx in first.items():
        for name in store.names(f"{folder}/{split}"):
            number = re.fullmatch(r"shard-(\d+)\.tar", name)
            if number and int(number[1]) >= idx:
                store.delete(f"{folder}/{split}/{name}")


def number_samples(
    df: DataFrame,
    order: Sequence[str],
    size: int = SHARD_SIZE,
    start_key: int = 0,
    start_idx: dict[str, int] | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Add ``n``, ``key``, ``shard_idx`` and ``shard`` to rows that have a ``split``."""
    keyed = assign_keys(df, order, start_key, block)
    return assign_shards(keyed, ["n"], size, start_idx, value_block("n"))
