"""Batches of consecutive samples, padded to the longest of each batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.arrays import QUANTIZERS, pad_to
from voxloom.operators.scan import dense_index


def plan_batches(
    df: DataFrame, order: Sequence[str], size: int = 8, block: Column | None = None
) -> DataFrame:
    """Add ``batch_id`` and ``pos``: ``size`` consecutive rows to a batch, the last may be short."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    ranked = dense_index(df, order, "_rank", block=block)
    return (
        ranked.withColumn("batch_id", F.floor(F.col("_rank") / size).cast("bigint"))
        .withColumn("pos", F.pmod(F.col("_rank"), F.lit(size)).cast("int"))
        .drop("_rank")
    )


def pad_batches(
    df: DataFrame, codes: str = "codes", audio: str = "audio", q: int = QUANTIZERS
) -> DataFrame:
    """Zero-pad code rows and audio to the longest of the batch; adds the true lengths.

    A batch has a fixed number of rows, so the window over it stays small.
    """
    sized = df.withColumn("code_len", F.size(codes)).withColumn("audio_len", F.size(audio))
    return pad_rows(longest_of_batch(sized), codes, audio, q)


def longest_of_batch(df: DataFrame) -> DataFrame:
    """Add ``_codes`` and ``_audio``, the greatest ``code_len`` and ``audio_len`` of each batch. Needs no payload."""
    batch = Window.partitionBy("batch_id")
    return df.withColumn("_codes", F.max("code_len").over(batch)).withColumn("_audio", F.max("audio_len").over(batch))


def pad_rows(longest: DataFrame, codes: str = "codes", audio: str = "audio", q: int = QUANTIZERS) -> DataFrame:
    """Zero-pad each row to the lengths that ``longest_of_batch`` found; no shuffle."""
    zero_row = F.array_repeat(F.lit(0), q)
    padded_codes = F.concat(codes, F.array_repeat(zero_row, F.col("_codes") - F.col("code_len")))
    return (
        longest.withColumn(codes, padded_codes)
        .withColumn(audio, pad_to(audio, F.col("_audio")))
        .drop("_codes", "_audio")
    )
