"""Which voiced segments exist, and how are they packed into chunks of fixed length?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.assemble import chunk_slices, timeline
from voxloom.operators.scan import BLOCK_ROWS
from voxloom.operators.segment import hysteresis, islands, segments, segments_or_whole


def voiced_segments(
    frames: DataFrame,
    clips: DataFrame,
    lo: float = 0.35,
    hi: float = 0.5,
    min_voiced: float = 1.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(clip_id, sr, s, e, padded) for frames(clip_id, frame_idx, prob) and clips(clip_id, sr, len)."""
    scored = hysteresis(frames, lo, hi, block_rows=block_rows, keep_block=True)
    return segments_or_whole(clips, segments(islands(scored, block_rows=block_rows), clips, min_voiced))


def segment_pieces(segs: DataFrame, gap: float = 0.1) -> DataFrame:
    """(clip_id, len): the length of each clip once its segments are joined with gaps."""
    step = (F.lit(gap) * F.col("sr")).cast("bigint")
    total = F.sum(F.col("e") - F.col("s") + step) - F.max(step)
    return segs.groupBy("clip_id").agg(total.alias("len"))


def packed_segments(
    frames: DataFrame, clips: DataFrame, lane, chunk: int, gap: int, **segmenting
) -> DataFrame:
    """Chunk slices of the joined voiced clips; ``lane`` is a column over ``clip_id``.

    Only bounds and lengths flow through this plan; samples are joined later, once.
    """
    pieces = segment_pieces(voiced_segments(frames, clips, **segmenting)).select(
        lane.alias("lane"), F.col("clip_id").alias("seq"), "clip_id", "len"
    )
    return chunk_slices(timeline(pieces, chunk, gap), chunk)
