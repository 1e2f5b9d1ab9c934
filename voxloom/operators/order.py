"""Reproducible shuffling, splitting, keys and shards. No order here depends on row arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.hashing import md5_key, uniform
from voxloom.operators.scan import BLOCK_ROWS, HASH_BLOCKS, dense_index, hash_block, value_block
from voxloom.session import stage

SHARD_SIZE = 6000
READ_ROWS = 64
OPEN_FILES = 8


def interleave_sources(
    df: DataFrame, file: str, row: str, seed: int, k: int = OPEN_FILES, batch_rows: int = READ_ROWS
) -> DataFrame:
    """Add ``wave``, ``batch_no`` and ``batch_key``: order by (wave, batch_key, file, row) to read.

    Files come in a random order, ``k`` at a time; within a wave the batches of its files are mixed.
    ``row`` is the row's index in its file. Only the list of files is ranked.
    """
    files = df.select(file).distinct().withColumn("_draw", md5_key(seed, file))
    ranked = dense_index(files, ["_draw", file], "_rank", block=hash_block(uniform("_draw")), levels=0)
    waves = stage(ranked.select(file, F.floor(F.col("_rank") / k).cast("bigint").alias("wave")), "waves")
    batch_no = F.floor(F.col(row) / batch_rows).cast("bigint")
    return (
        df.withColumn("batch_no", batch_no)
        .withColumn("batch_key", md5_key(seed, file, "batch_no"))
        .join(waves, file)
    )


def global_shuffle(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Add ``out``: the place of each row in a uniformly random order fixed by ``seed``."""
    drawn = df.withColumn("_draw", md5_key(seed, key))
    return dense_index(drawn, ["_draw", key], out, block=hash_block(uniform("_draw"), HASH_BLOCKS), levels=0).drop("_draw")


def bounded_shuffle(
    df: DataFrame, seq: str, window: int, seed: int, out: str = "position", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``out``: a random order in which no row leaves the window ahead of its place."""
    draw = md5_key(seed, seq)
    target = F.col(seq) + F.floor(uniform("_draw") * F.lit(window)).cast("bigint")
    moved = df.withColumn("_draw", draw).withColumn("_target", target)
    ordered = dense_index(moved, ["_target", "_draw", seq], out, block=value_block("_target", block_rows))
    return ordered.drop("_draw", "_target")


def split_train_val(df: DataFrame, key: str | Sequence[str], frac: float, seed: int) -> DataFrame:
    """Add ``split``: an independent draw per key, ``val`` below ``frac``. No shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    u = uniform(md5_key(seed + 1, *keys))
    return df.withColumn("split", F.when(u < F.lit(frac), F.lit("val")).otherwise(F.lit("train")))


def assign_keys(
    df: DataFrame, order: Sequence[str], start: int = 0, block: Column | None = None
) -> DataFrame:
    """Add ``n`` and ``key``: a dense global counter, as text of at least eight digits."""
    indexed = dense_index(df, order, "n", block=block, start=start)
    return indexed.withColumn("key", F.format_string("%08d", "n"))


def assign_shards(
    df: DataFrame,
    order: Sequence[str],
    size: int = SHARD_SIZE,
    start_idx: dict[str, int] | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Add ``shard_idx`` and ``shard``: consecutive rows of each split, ``size`` to a shard."""
    ranked = dense_index(df, order, "_in_split", within=["split"], block=block)
    first = F.lit(0)
    for split, idx in (start_idx or {}).items():
        first = F.when(F.col("split") == split, F.lit(idx)).otherwise(first)
    shard = (first + F.floor(F.col("_in_split") / size)).cast("bigint")
    named = ranked.withColumn("shard_idx", shard)
    return named.withColumn("shard", F.format_string("shard-%06d.tar", "shard_idx")).drop("_in_split")


def take_valid(df: DataFrame, valid: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` valid rows in order, as a top-n without a full sort."""
    return df.where(valid).orderBy(*order).limit(n)
