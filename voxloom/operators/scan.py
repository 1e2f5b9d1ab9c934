"""Ordered scans that stay parallel inside one key.

A plain ``Window.partitionBy(key)`` puts a whole key on one task. Here each key is cut into blocks
of consecutive order values. The window runs per (key, block); one summary row per block is scanned
per key; the carried value is joined back on (key, block). The data is shuffled once, on
(key, block), however hot a key is, and the summary is smaller by the block size.

Blocks are ranges of values, so an order with large gaps (hashed or 64-bit ids) may have a block for each
row. ``levels`` then cuts the summary in the same way: 2^``FAN_BITS`` blocks are gathered and scanned
together, and what these begin with is found one level up. One level brings all 64-bit integers, in
blocks of ``BLOCK_ROWS``, down to 2^24 summary rows for one task; it costs a shuffle of the summary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import stage

BLOCK_ROWS = 65536
HASH_BLOCKS = 65536
FAN_BITS = 24
SPARSE = 1  # levels for an order of any integers
BLOCK = "_block"


def value_block(order: Column | str, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer order column: at most ``rows`` distinct values per block."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(rows)).cast("bigint")


def hash_block(u: Column, blocks: int = HASH_BLOCKS) -> Column:
    """Block number of a uniform number in [0, 1)."""
    return F.floor(u * F.lit(blocks)).cast("bigint")


def range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Blocks for an order of any type: Spark's own range partitioning, stamped and staged.

    Staging fixes the sampled bounds, so a recomputed task sees the same blocks.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return stage(ranged.withColumn(BLOCK, F.spark_partition_id().cast("bigint")), "range-blocks")


def block_window(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    partials: dict[str, Column],
    merge: dict[str, Callable[[Column], Column]],
    levels: int = 0,
) -> DataFrame:
    """Join to each row, under each name, the merge of all earlier blocks of its key.

    ``partials`` are aggregates per block (combined map-side); ``merge`` aggregates them over the
    earlier blocks and ignores NULL. With ``levels`` it must not depend on their order. Rows of a key's first block get NULL.
    """
    per_block = df.groupBy(*keys, BLOCK).agg(*[agg.alias(name) for name, agg in partials.items()])
    return df.join(_carries(per_block, keys, merge, levels), [*keys, BLOCK], "left")


def _carries(
    blocks: DataFrame, keys: Sequence[str], merge: dict[str, Callable[[Column], Column]], levels: int
) -> DataFrame:
    """For each block the merge of all earlier blocks of its key."""
    group, rows = [*keys], blocks
    if levels:
        group, up = [*keys, "_up"], F.shiftright(BLOCK, FAN_BITS)
        rows = blocks.withColumn("_up", up)
        above = rows.groupBy(*group).agg(*[merge[name](F.col(name)).alias(name) for name in merge])
        entered = _carries(above.withColumnRenamed("_up", BLOCK), keys, merge, levels - 1)
        # What a group of blocks begins with stands before its first block.
        before = entered.withColumnRenamed(BLOCK, "_up").withColumn(BLOCK, F.lit(None).cast("bigint"))
        rows = rows.unionByName(before)
    earlier = Window.partitionBy(*group).orderBy(F.col(BLOCK).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select(*keys, BLOCK, *[merge[name](F.col(name)).over(earlier).alias(name) for name in merge])
    return carried.where(F.col(BLOCK).isNotNull()) if levels else carried


def dense_index(
    df: DataFrame,
    order: Sequence[str],
    out: str,
    within: Sequence[str] = (),
    block: Column | None = None,
    start: int = 0,
    levels: int = SPARSE,
) -> DataFrame:
    """Gap-free index from ``start`` in the given unique order, globally or within groups.

    ``block`` must not decrease along the order (see :func:`value_block`, :func:`hash_block`).
    Without it the rows are range-partitioned and staged first. ``levels`` of 0 is for blocks that are few in
    each group.
    """
    if block is None:
        blocked, levels = range_blocks(df, [*within, *order]), 0
    else:
        blocked = df.withColumn(BLOCK, block)
    local = F.row_number().over(block_window(within, order))
    indexed = with_carry(blocked, within, {"_before": F.count(F.lit(1))}, {"_before": F.sum}, levels)
    index = local.cast("bigint") - 1 + F.coalesce(F.col("_before"), F.lit(0)) + F.lit(start)
    return indexed.withColumn(out, index.cast("bigint")).drop(BLOCK, "_before")


def running_sum(
    df: DataFrame,
    value: Column,
    out: str,
    keys: Sequence[str],
    order: str,
    inclusive: bool = True,
    block_rows: int = BLOCK_ROWS,
    levels: int = 0,
) -> DataFrame:
    """Running total of ``value`` along an integer order, with or without the current row."""
    last = Window.currentRow if inclusive else -1
    frame = block_window(keys, [order]).rowsBetween(Window.unboundedPreceding, last)
    blocked = df.withColumn("_value", value).withColumn(BLOCK, value_block(order, block_rows))
    carried = with_carry(blocked, keys, {"_carry": F.sum("_value")}, {"_carry": F.sum}, levels)
    zero = F.lit(0)
    total = F.coalesce(F.sum("_value").over(frame), zero) + F.coalesce(F.col("_carry"), zero)
    return carried.withColumn(out, total).drop("_value", "_carry", BLOCK)


def earlier_min(
    df: DataFrame,
    value: Column,
    out: str,
    keys: Sequence[str],
    order: str,
    block_rows: int = BLOCK_ROWS,
    levels: int = 0,
) -> DataFrame:
    """Least ``value`` among all strictly earlier rows of the key; NULL where there is none."""
    frame = block_window(keys, [order]).rowsBetween(Window.unboundedPreceding, -1)
    blocked = df.withColumn("_value", value).withColumn(BLOCK, value_block(order, block_rows))
    carried = with_carry(blocked, keys, {"_carry": F.min("_value")}, {"_carry": F.min}, levels)
    least = F.least(F.min("_value").over(frame), F.col("_carry"))
    return carried.withColumn(out, least).drop("_value", "_carry", BLOCK)
