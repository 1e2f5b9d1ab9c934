"""From frame scores to voiced segments: window functions over (clip, block)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.arrays import bind, pad_edges, rms, zeros
from voxloom.operators.scan import BLOCK, BLOCK_ROWS, block_window, running_sum, value_block, with_carry
from voxloom.session import stage

# Fixed values of the frame grid: samples per frame at the frame rate, and edge padding in seconds.
FRAME = 512
FRAME_RATE = 16000
EDGE_PAD_S = 0.5


def frame_signal(
    signals: DataFrame,
    score: Callable[[Column], Column] | None = None,
    frame: int = FRAME,
    clip: str = "clip_id",
    samples: str = "samples",
) -> DataFrame:
    """One row per frame with its score; an incomplete frame and the last frame score 0.

    ``score`` maps an array column to a number (default: root mean square). Frames are cut inside
    the row, so nothing is shuffled.
    """
    score = score or rms

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(s) - 1, F.lit(frame))
        return F.when(F.size(s) > 0, F.transform(starts, lambda i: F.slice(s, i + 1, F.lit(frame))))

    count = F.ceil(F.size(samples) / frame).cast("int")
    framed = signals.select(
        clip, count.alias("_n"), F.posexplode(bind(F.col(samples), cut)).alias("frame_idx", "frame")
    )
    scored = F.when((F.size("frame") < frame) | (F.col("frame_idx") == F.col("_n") - 1), F.lit(0.0))
    return framed.select(clip, "frame_idx", scored.otherwise(score(F.col("frame"))).alias("prob"))


def hysteresis(
    frames: DataFrame,
    lo: float = 0.35,
    hi: float = 0.5,
    clip: str = "clip_id",
    idx: str = "frame_idx",
    score: str = "prob",
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add ``voiced``: on at ``hi``, off at ``lo``, in between the last decision, at first off.

    With ``keep_block`` the block column stays, and :func:`islands` goes on without a shuffle.
    """
    p = F.col(score)
    decided = F.when(F.isnan(p), F.lit(None)).when(p >= hi, True).when(p <= lo, False)
    blocked = frames.withColumn("_decided", decided).withColumn(BLOCK, value_block(idx, block_rows))
    when_decided = F.when(F.col("_decided").isNotNull(), F.col(idx))
    carried = with_carry(
        blocked,
        [clip],
        {"_carry": F.max_by("_decided", when_decided)},
        {"_carry": lambda c: F.last(c, ignorenulls=True)},
    )
    so_far = block_window([clip], [idx]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last("_decided", ignorenulls=True).over(so_far)
    voiced = F.coalesce(held, F.col("_carry"), F.lit(False))
    done = carried.withColumn("voiced", voiced).drop("_decided", "_carry")
    return done if keep_block else done.drop(BLOCK)


def islands(
    frames: DataFrame, clip: str = "clip_id", idx: str = "frame_idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Maximal runs of adjacent voiced frames as (clip, f_start, f_end).

    ``block_rows`` must be that of :func:`hysteresis` if the frames come with their block.

    Runs are found per (clip, block). Only runs that touch a block edge, at most two per block,
    are stitched per clip; all others are final already.
    """
    blocked = frames if BLOCK in frames.columns else frames.withColumn(BLOCK, value_block(idx, block_rows))
    voiced = blocked.where("voiced").select(clip, idx, BLOCK)
    run = F.col(idx) - F.row_number().over(block_window([clip], [idx]))
    runs = (
        voiced.withColumn("_run", run)
        .groupBy(clip, BLOCK, "_run")
        .agg(F.min(idx).cast("bigint").alias("f_start"), F.max(idx).cast("bigint").alias("f_end"))
    )
    # Read by two branches below, whose filters would keep Catalyst from sharing the frame shuffle.
    runs = stage(runs.drop("_run"), "runs")
    at_edge = (F.col("f_start") == F.col(BLOCK) * block_rows) | (
        F.col("f_end") == (F.col(BLOCK) + 1) * block_rows - 1
    )
    inner = runs.where(~at_edge).select(clip, "f_start", "f_end")
    by_clip = Window.partitionBy(clip).orderBy("f_start")
    is_first = F.coalesce(F.col("f_start") > F.lag("f_end").over(by_clip) + 1, F.lit(True))
    stitched = (
        runs.where(at_edge)
        .withColumn("_first", is_first.cast("int"))
        .withColumn("_group", F.sum("_first").over(by_clip.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(clip, "_group")
        .agg(F.min("f_start").alias("f_start"), F.max("f_end").alias("f_end"))
        .select(clip, "f_start", "f_end")
    )
    return inner.unionByName(stitched)


def edge_pad(sr: Column) -> Column:
    """Samples of silence added at each side before scoring."""
    return (sr * F.lit(EDGE_PAD_S)).cast("bigint")


def segments(
    runs: DataFrame, clips: DataFrame, min_voiced: float = 1.0, clip: str = "clip_id"
) -> DataFrame:
    """Sample ranges ``[s, e)`` of long enough runs, in coordinates of the edge-padded clip.

    ``clips`` holds (clip, sr, len) once per clip; ``len`` is the unpadded length. The double
    arithmetic divides first and then multiplies by the rate.
    """
    sr = F.col("sr")
    at = lambda frame: (frame * FRAME / F.lit(FRAME_RATE) * sr).cast("bigint")
    padded_len = F.col("len") + F.lit(2) * edge_pad(sr)
    return (
        runs.join(clips.select(clip, "sr", "len"), clip)
        .withColumn("s", F.greatest(F.lit(0).cast("bigint"), at(F.col("f_start"))))
        .withColumn("e", F.least(padded_len.cast("bigint"), at(F.col("f_end") + 1)))
        .where(F.col("e") - F.col("s") >= (F.lit(min_voiced) * sr).cast("bigint"))
        .select(clip, "sr", "s", "e", F.lit(True).alias("padded"))
    )


def segments_or_whole(clips: DataFrame, segs: DataFrame, clip: str = "clip_id") -> DataFrame:
    """The segments of all ``clips``, and the whole unpadded clip for every clip that has none."""
    found = segs.select(clip, "s", "e", "padded")
    bare = F.col("s").isNull()
    return clips.join(found, clip, "left").select(
        clip,
        "sr",
        F.when(bare, F.lit(0).cast("bigint")).otherwise(F.col("s")).alias("s"),
        F.when(bare, F.col("len").cast("bigint")).otherwise(F.col("e")).alias("e"),
        (~bare & F.col("padded")).alias("padded"),
    )


def rejoin(segs: DataFrame, gap: float = 0.1, clip: str = "clip_id", block_rows: int = 1 << 30) -> DataFrame:
    """Add ``out_start``: where each segment begins once a clip's segments are joined with gaps.

    The order column is the start sample, so ``block_rows`` counts samples.
    """
    step = F.col("e") - F.col("s") + (F.lit(gap) * F.col("sr")).cast("bigint")
    return running_sum(segs, step, "out_start", [clip], "s", inclusive=False, block_rows=block_rows)


def rejoin_payload(segs: DataFrame, signals: DataFrame, gap: float = 0.1, clip: str = "clip_id") -> DataFrame:
    """The joined signal of each clip. Only segment bounds are grouped; samples stay in their row."""
    bounds = segs.groupBy(clip).agg(
        F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_bounds"), F.first("padded").alias("_padded")
    )
    sr, samples = F.col("sr"), F.col("samples")
    base = F.when(F.col("_padded"), pad_edges(samples, edge_pad(sr))).otherwise(samples)
    silence = zeros((F.lit(gap) * sr).cast("bigint"))

    def join(source: Column) -> Column:
        piece = lambda b: F.slice(
            source["base"], (b["s"] + 1).cast("int"), (b["e"] - b["s"]).cast("int")
        )
        spaced = lambda b, i: F.when(i == 0, piece(b)).otherwise(F.concat(source["gap"], piece(b)))
        return F.flatten(F.transform("_bounds", spaced))

    source = F.struct(base.alias("base"), silence.alias("gap"))
    return signals.join(bounds, clip).select(clip, "sr", bind(source, join).alias("samples"))
