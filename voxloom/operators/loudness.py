"""Block loudness and gain. The signal is taken as given: no frequency weighting is applied here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.arrays import bind, indices
from voxloom.operators.scan import BLOCK, BLOCK_ROWS, value_block

# Block seconds, blocks per hop, gates and targets in dB, and the loudness offset.
BLOCK_S = 0.4
HOPS_PER_BLOCK = 4
ABSOLUTE_GATE = -70.0
RELATIVE_GATE = -10.0
LOUDNESS_OFFSET = -0.691
TARGET = -23.0
CEILING = -1.0


def hop_sums(samples: Column | str, hop: int) -> Column:
    """Sum of squares of each complete hop, formed inside the row."""

    def sums(s: Column) -> Column:
        square_sum = lambda i: F.aggregate(
            F.slice(s, i * hop + 1, F.lit(hop)), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")
        )
        return F.transform(indices(F.floor(F.size(s) / F.lit(hop)).cast("int")), square_sum)

    return bind(F.col(samples) if isinstance(samples, str) else samples, sums)


def block_energies(samples: Column | str, hop: int) -> Column:
    """Mean square of each complete block of four hops, one block per hop."""

    def means(sums: Column) -> Column:
        total = lambda i: F.aggregate(
            F.slice(sums, i + 1, F.lit(HOPS_PER_BLOCK)), F.lit(0.0), lambda a, v: a + v
        )
        blocks = F.size(sums) - (HOPS_PER_BLOCK - 1)
        return F.transform(indices(blocks), lambda i: total(i) / F.lit(HOPS_PER_BLOCK * hop))

    return bind(hop_sums(samples, hop), means)


def block_energy(
    signals: DataFrame, hop: int, clip: str = "clip_id", samples: str = "samples"
) -> DataFrame:
    """(clip, block_idx, energy) of every complete block; no shuffle."""
    return signals.select(clip, F.posexplode(block_energies(samples, hop)).alias("block_idx", "energy"))


def to_loudness(energy: Column) -> Column:
    return F.when(energy > 0, F.lit(LOUDNESS_OFFSET) + F.lit(10.0) * F.log10(energy))


def gated_loudness(
    blocks: DataFrame,
    clip: str = "clip_id",
    idx: str = "block_idx",
    energy: str = "energy",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Two-pass gated loudness per clip; NULL where no block passes.

    First gate: blocks over -70. Second gate: blocks over -70 and over the loudness of the first
    mean less 10. The first mean reaches the rows through per-block sums joined on (clip, block),
    so a very long clip is never on one task.
    """
    e = F.col(energy)
    loud = F.coalesce(to_loudness(e) > ABSOLUTE_GATE, F.lit(False))
    gated = blocks.withColumn(BLOCK, value_block(idx, block_rows)).withColumn("_loud", loud)
    sums = gated.groupBy(clip, BLOCK).agg(
        F.sum(F.when(F.col("_loud"), e)).alias("_sum"), F.count(F.when(F.col("_loud"), 1)).alias("_n")
    )
    whole = Window.partitionBy(clip)
    first_mean = F.sum("_sum").over(whole) / F.nullif(F.sum("_n").over(whole), F.lit(0))
    gates = sums.select(clip, BLOCK, (to_loudness(first_mean) + RELATIVE_GATE).alias("_gate"))
    kept = F.col("_loud") & F.coalesce(to_loudness(e) > F.col("_gate"), F.lit(False))
    return (
        gated.join(gates, [clip, BLOCK])
        .groupBy(clip)
        .agg(F.avg(F.when(kept, e)).alias("_mean"), F.count(F.when(kept, 1)).alias("n_blocks"))
        .select(clip, to_loudness(F.col("_mean")).alias("loudness"), "n_blocks")
    )


def signal_loudness(energies: Column) -> Column:
    """``gated_loudness`` of the block energies of one signal, inside the row; NULL where no block passes."""

    def mean(blocks: Column) -> Column:
        total = F.aggregate(blocks, F.lit(0.0), lambda a, e: a + e)
        return total / F.nullif(F.size(blocks), F.lit(0))

    def second(loud: Column) -> Column:
        over = lambda gate: F.filter(loud, lambda e: F.coalesce(to_loudness(e) > gate, F.lit(False)))
        kept = bind(to_loudness(mean(loud)) + RELATIVE_GATE, over)
        return bind(bind(kept, mean), to_loudness)

    return bind(F.filter(energies, lambda e: F.coalesce(to_loudness(e) > ABSOLUTE_GATE, F.lit(False))), second)


def peak(samples: Column | str) -> Column:
    return F.array_max(F.transform(samples, lambda v: F.abs(v).cast("double")))


def normalize_gain(
    loudness: Column | str, top: Column | str, target: float = TARGET, ceiling: float = CEILING
) -> Column:
    """Linear gain to the target loudness; lowered so that the peak is at the ceiling if it would clip.

    No loudness (a silent signal) gives gain 1.
    """
    level = F.col(loudness) if isinstance(loudness, str) else loudness
    highest = F.col(top) if isinstance(top, str) else top
    gain = F.pow(F.lit(10.0), (F.lit(target) - level) / 20.0)
    limited = F.when(highest * gain >= 1.0, F.pow(F.lit(10.0), F.lit(ceiling / 20.0)) / highest).otherwise(gain)
    return F.when(level.isNull(), F.lit(1.0)).otherwise(limited)


def apply_gain(samples: Column | str, gain: Column | str) -> Column:
    factor = F.col(gain) if isinstance(gain, str) else gain
    return bind(factor, lambda g: F.transform(samples, lambda v: (v.cast("double") * g).cast("float")))
