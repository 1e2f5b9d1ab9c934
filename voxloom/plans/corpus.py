"""Corpus preparation and shard loading, each as one chain of operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import arrays
from voxloom.functions.hashing import md5_key, uniform
from voxloom.functions.payloads import npy_bytes, sample_decoder, wav_bytes
from voxloom.operators.assemble import chunk_slices, materialize_chunks, timeline
from voxloom.operators.batches import longest_of_batch, pad_rows, plan_batches
from voxloom.operators.loudness import apply_gain, block_energies, normalize_gain, peak, signal_loudness
from voxloom.operators.order import split_train_val, take_valid
from voxloom.operators.quality import skip_report
from voxloom.operators.scan import hash_block
from voxloom.operators.segment import (
    edge_pad,
    frame_signal,
    hysteresis,
    islands,
    rejoin_payload,
    segments,
    segments_or_whole,
)
from voxloom.session import stage
from voxloom.sinks.shards import number_samples
from voxloom.sources.shards import list_shards, read_shards


def level_signals(signals: DataFrame, hop: int) -> DataFrame:
    """signals(clip_id, sr, samples) brought to the target loudness; adds ``loudness`` (0 if silent). No shuffle."""
    padded = signals.withColumn("samples", arrays.pad_to("samples", F.lit(4 * hop)))
    measured = padded.withColumn("loudness", signal_loudness(block_energies("samples", hop)))
    gain = normalize_gain("loudness", peak("samples"))
    return measured.withColumn("samples", apply_gain("samples", gain)).withColumn(
        "loudness", F.coalesce("loudness", F.lit(0.0))
    )


def voiced_signals(
    signals: DataFrame, score: Callable[[Column], Column], frame: int, lo: float, hi: float, min_voiced: float, gap: float
) -> DataFrame:
    """The signals without their unvoiced parts. Scores are computed on the edge-padded signal."""
    padded = signals.withColumn("samples", arrays.pad_edges("samples", edge_pad(F.col("sr"))))
    voiced = hysteresis(frame_signal(padded, score, frame), lo, hi, keep_block=True)
    clips = signals.select("clip_id", "sr", F.size("samples").cast("bigint").alias("len"))
    segs = segments_or_whole(clips, segments(islands(voiced), clips, min_voiced))
    return rejoin_payload(segs, signals, gap)


def chunk_signals(signals: DataFrame, lane: Column, chunk: int, gap: int) -> DataFrame:
    """signals(clip_id, samples) packed into chunks(lane, chunk, samples) in ``clip_id`` order.

    The signals are read for their lengths and for their samples; give a written table.
    """
    lengths = signals.select(
        lane.alias("lane"), F.col("clip_id").alias("seq"), "clip_id", F.size("samples").cast("bigint").alias("len")
    )
    slices = chunk_slices(timeline(lengths, chunk, gap), chunk)
    slices = stage(slices, "chunk-slices") if gap >= chunk else slices  # read twice then
    return materialize_chunks(slices, signals, chunk, silent=gap >= chunk)


def number_chunks(
    ids: DataFrame, seed: int, val_fraction: float, shard_size: int, start_key: int = 0, start_idx: dict[str, int] | None = None
) -> DataFrame:
    """ids(lane, chunk) shuffled, split, keyed and sharded: adds split, n, key, shard_idx and shard."""
    drawn = ids.select("lane", "chunk").withColumn("_draw", md5_key(seed, "lane", "chunk"))
    split = split_train_val(drawn, ["lane", "chunk"], val_fraction, seed)
    order = ["_draw", "lane", "chunk"]
    return number_samples(split, order, shard_size, start_key, start_idx, block=hash_block(uniform("_draw"))).drop("_draw")


def encoded_chunks(chunks: DataFrame, numbered: DataFrame, codes: Column, sr: int) -> DataFrame:
    """(split, shard, key, members) of numbered chunks; the samples are encoded as (wav, npy) and joined to the numbers once."""
    members = F.create_map(
        F.lit("wav"), wav_bytes(arrays.pcm16("samples"), F.lit(sr)), F.lit("npy"), npy_bytes(codes)
    )
    encoded = chunks.select("lane", "chunk", members.alias("members"))
    return numbered.join(encoded, ["lane", "chunk"]).select("split", "shard", "key", "members")


def shard_samples(
    chunks: DataFrame, codes: Column, sr: int, seed: int, val_fraction: float, shard_size: int, start_key: int = 0
) -> DataFrame:
    """chunks(lane, chunk, samples) shuffled, split, keyed, sharded and encoded as (wav, npy) members."""
    return encoded_chunks(chunks, number_chunks(chunks, seed, val_fraction, shard_size, start_key), codes, sr)


def training_samples(
    samples: DataFrame, seed: int, min_s: float, max_s: float, decode: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """(shard, key, codes, audio, sr, skip_reason) of every sample, cropped; the payload is NULL where skipped.

    ``decode`` turns the bytes of the codes and of the audio into struct(codes, sr, samples) and may leave
    out the audio of samples that are too short; without it, npy and 16-bit wav are read.
    """
    payload, _ = arrays.pick_payload("members")
    decode = decode or sample_decoder(arrays.min_code_count(min_s))
    read = samples.select(
        "shard", "key", payload.isNotNull().alias("_audio"),
        decode(F.try_element_at("members", F.lit("npy")), payload).alias("_sample"),
    ).select("shard", "key", "_audio", "_sample.*")
    matrix = read.withColumn("_matrix", arrays.codes_matrix("codes"))
    crop = arrays.aligned_crop("_matrix", "samples", "sr", max_s, seed, "shard", "key")
    cropped = matrix.withColumn("_crop", crop)
    reason = F.coalesce(
        arrays.codes_skip_reason("codes"),
        F.when(~arrays.enough_codes(F.size("_matrix"), min_s), F.lit("duration")),
        F.when(~F.col("_audio"), F.lit("no_audio")),
        F.when(F.col("samples").isNull(), F.lit("undecodable")),
        F.when(~F.coalesce(arrays.loud_enough_db("_crop.audio"), F.lit(False)), F.lit("rms")),
    )
    judged = cropped.select("shard", "key", "_crop", "sr", reason.alias("skip_reason"))
    kept = lambda c: F.when(F.col("skip_reason").isNull(), F.col(f"_crop.{c}")).alias(c)
    return judged.select("shard", "key", kept("codes"), kept("audio"), "sr", "skip_reason")


def batch_samples(loaded: DataFrame, size: int, seed: int) -> DataFrame:
    """Padded batches of the kept rows of ``training_samples``; give a written table.

    Order, batches and padded lengths are decided on ids and lengths; the payload is joined to them once.
    """
    kept = loaded.where(F.col("skip_reason").isNull())
    lengths = kept.select(
        "_row", "shard", "key", F.size("codes").alias("code_len"), F.size("audio").alias("audio_len"),
        md5_key(seed, "shard", "key").alias("_draw"),
    )
    planned = plan_batches(lengths, ["_draw", "shard", "key", "_row"], size, hash_block(uniform("_draw")))
    longest = longest_of_batch(planned).drop("_draw", "shard", "key")
    return pad_rows(kept.drop("skip_reason").join(longest, "_row")).drop("_row")


def load_training(
    spark: SparkSession,
    pattern: str,
    size: int,
    seed: int,
    min_s: float = 1.0,
    max_s: float = 10.0,
    decode: Callable[[Column, Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Shards to padded batches, and the count of samples for each skip reason, which add up to the input."""
    judged = training_samples(read_shards(spark, pattern), seed, min_s, max_s, decode)
    loaded = stage(judged.withColumn("_row", F.monotonically_increasing_id()), "loaded")
    return batch_samples(loaded, size, seed), skip_report(loaded, by=())


def load_batches(
    spark: SparkSession,
    pattern: str,
    size: int,
    seed: int,
    min_s: float = 1.0,
    max_s: float = 10.0,
    decode: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Shards to padded batches: decode, drop short, crop, drop quiet, shuffle, batch, pad."""
    return load_training(spark, pattern, size, seed, min_s, max_s, decode)[0]


def judged_samples(
    samples: DataFrame, min_s: float, max_s: float, decode: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """Decoded evaluation samples with the reason to skip each; every sample gives a row."""
    payload, _ = arrays.pick_payload("members")
    decode = decode or sample_decoder(arrays.min_code_count(min_s), arrays.min_code_count(max_s))
    decoded = samples.select(
        "shard", "key", payload.isNotNull().alias("_audio"),
        decode(F.try_element_at("members", F.lit("npy")), payload).alias("_sample"),
    )
    read = decoded.select("shard", "key", "_audio", "_sample.*")
    reason = F.coalesce(
        arrays.codes_skip_reason("codes"),
        arrays.duration_skip_reason(F.size("codes") / F.lit(arrays.QUANTIZERS), min_s, max_s),
        F.when(~F.col("_audio") | F.col("samples").isNull(), F.lit("no_audio")),
        F.when(~F.coalesce(arrays.loud_enough_amp("samples"), F.lit(False)), F.lit("rms")),
    )
    codes = arrays.codes_matrix("codes").alias("codes")
    return read.select("shard", "key", codes, F.col("samples").alias("audio"), "sr", reason.alias("skip_reason"))


def load_evaluation_samples(
    spark: SparkSession, pattern: str, n: int, min_s: float = 1.0, max_s: float = 10.0, first: int = 8,
    decode: Callable[[Column, Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` valid samples in (shard, key) order, and skip counts up to the last of them.

    Shards are read in order, ``first`` of them and then twice as many each time, until there are
    enough valid samples: later shards are never opened.
    """
    paths, parts, valid, at = list_shards(spark, pattern), [], 0, 0
    while not parts or (valid < n and at < len(paths)):
        some = paths[at : at + first]
        parts.append(stage(judged_samples(read_shards(spark, some), min_s, max_s, decode), "judged"))
        valid += parts[-1].where(F.col("skip_reason").isNull()).count()
        at, first = at + len(some), 2 * first
    judged = reduce(DataFrame.unionByName, parts)
    kept = take_valid(judged, F.col("skip_reason").isNull(), ["shard", "key"], n)
    place = F.struct("shard", "key")
    last = kept.agg(F.max(place)).first()[0]
    examined = judged
    if valid >= n and last is not None:
        examined = judged.where(place <= F.struct(F.lit(last["shard"]), F.lit(last["key"])))
    return kept.drop("skip_reason"), skip_report(examined, by=())
