"""Preparation of a corpus from encoded clips to committed shards, in one run that can be resumed."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import arrays
from voxloom.functions.hashing import md5_key
from voxloom.functions.payloads import wav_signal
from voxloom.operators.order import OPEN_FILES
from voxloom.operators.quality import pending_inputs, stop_on_drift
from voxloom.operators.scan import dense_index
from voxloom.plans.corpus import chunk_signals, encoded_chunks, level_signals, number_chunks, voiced_signals
from voxloom.session import discard, scratch, spread, stage
from voxloom.sinks.shards import drop_shards_from, write_shards
from voxloom.sources.clips import read_clip_groups
from voxloom.sources.store import recover
from voxloom.streaming.state import newest_version, read_output, write_version

LEDGER = "wave bigint, next_train_shard_idx bigint, next_val_shard_idx bigint, global_key bigint, args string"
FILES = "path string"
SKIPS = "skip_reason string, n bigint"
SPLITS = ("train", "val")


@dataclass(frozen=True)
class Preparation:
    """Settings of a run. Lengths are in samples unless they end in ``_s``."""

    sr: int
    chunk: int
    gap: int
    hop: int
    frame: int
    low: float
    high: float
    min_voiced_s: float
    join_gap_s: float
    seed: int
    val_fraction: float
    shard_size: int
    sr_min: int = arrays.MIN_RATE
    wave_files: int = OPEN_FILES

    def args(self) -> dict:
        """What a later start is compared with."""
        return {"shard_size": self.shard_size, "seed": self.seed, "val_percent": self.val_fraction * 100, "duration": self.chunk / self.sr}


def read_signals(clips: DataFrame, decode: Callable[[str], Column], sr_min: int) -> DataFrame:
    """(path, row, sr, samples, skip_reason, rows): decoded clips, or why there is none. Empty payloads are left out and not counted."""
    whole = clips.where(F.col("skip_reason").isNotNull() | arrays.nonempty_payload("payload"))
    decoded = whole.select("path", "row", "rows_lost", "skip_reason", decode("payload").alias("_signal"))
    sr, samples = F.col("_signal.sr"), F.col("_signal.samples")
    reason = F.coalesce(
        "skip_reason",
        F.when(samples.isNull() | (F.size(samples) == 0), F.lit("undecodable")),
        arrays.rate_skip_reason(sr, sr_min),
    )
    rows = F.coalesce("rows_lost", F.lit(1)).cast("bigint")
    return decoded.select("path", "row", sr.alias("sr"), samples.alias("samples"), reason.alias("skip_reason"), rows.alias("rows"))


def prepare_corpus(
    spark: SparkSession,
    inputs: DataFrame,
    folder: str,
    settings: Preparation,
    codes: Callable[[str], Column],
    read: Callable[[SparkSession, list[str]], DataFrame] = read_clip_groups,
    decode: Callable[[str], Column] = wav_signal,
    score: Callable[[Column], Column] = arrays.rms,
    name: Callable[[Column], Column] = lambda path: path,
) -> DataFrame:
    """Prepare the files of ``inputs(path)`` into ``<folder>/shards`` and return the ledger of the run.

    Files are taken in a random order, ``wave_files`` at a time. A wave is read, decoded, levelled, stripped of what is unvoiced, packed
    into chunks (a lane for each file), shuffled, split, keyed, sharded and written by one commit. Then its row of the ledger, its files
    and its skip counts are written: a file counts as done only with its shards, and a wave that died leaves nothing behind.
    A further call goes on with the files that are pending; other values of hard settings stop it. The last shard of a wave may be short.

    ``read(spark, paths)`` gives (payload, path, row, rows_lost, skip_reason); ``codes("samples")`` the codes of a chunk. ``name`` of a path is
    its lane and what its random place depends on, so that a corpus that is moved is prepared alike.
    """
    shards = f"{folder}/shards"
    recover(spark, shards)
    last = ledger(spark, folder).orderBy(F.desc("wave")).first()
    stop_on_drift(spark, json.loads(last["args"]) if last else None, settings.args())
    named = inputs.select("path", name(F.col("path")).alias("_name")).distinct()
    left = stage(pending_inputs(named, completed_inputs(spark, folder)).join(named, "path"), "pending")
    order = [md5_key(settings.seed, "_name"), F.col("_name"), F.col("path")]
    placed = stage(dense_index(left.withColumn("_draw", order[0]), ["_draw", "_name", "path"], "_place"), "pending-files")
    first = int(last["wave"]) + 1 if last else 0
    for at in range(-(-placed.count() // settings.wave_files)):
        low, high = at * settings.wave_files, (at + 1) * settings.wave_files
        paths = [r["path"] for r in placed.where((F.col("_place") >= low) & (F.col("_place") < high)).select("path").collect()]
        with scratch() as inner:
            _wave(spark, folder, settings, first + at, sorted(paths), codes, read, decode, score, name)
        discard(spark, inner)
    return ledger(spark, folder)


def _wave(
    spark: SparkSession, folder: str, settings: Preparation, wave: int, paths: Sequence[str], codes: Callable, read: Callable,
    decode: Callable, score: Callable, name: Callable,
) -> None:
    before = ledger(spark, folder).where(F.col("wave") == wave - 1).first()
    at = {s: before[f"next_{s}_shard_idx"] if before else 0 for s in SPLITS}
    key = before["global_key"] if before else 0
    drop_shards_from(spark, f"{folder}/shards", at)
    # A wave is a few files; decoding and levelling are dealt to all cores.
    judged = stage(read_signals(spread(read(spark, list(paths)), "path", "row"), decode, settings.sr_min), "prepared-clips")
    kept = judged.where(F.col("skip_reason").isNull())
    ids = dense_index(kept.select("path", "row"), ["path", "row"], "clip_id")
    numbered_clips = kept.join(ids, ["path", "row"]).select("clip_id", name(F.col("path")).alias("lane"), "sr", "samples")
    signals = stage(spread(numbered_clips, "clip_id"), "prepared-signals")
    level = stage(level_signals(signals.drop("lane"), settings.hop), "prepared-level")
    voiced = voiced_signals(
        level, score, settings.frame, settings.low, settings.high, settings.min_voiced_s, settings.join_gap_s
    ).join(signals.select("clip_id", "lane"), "clip_id")
    chunks = stage(chunk_signals(stage(voiced, "prepared-voiced"), F.col("lane"), settings.chunk, settings.gap), "prepared-chunks")
    numbered = stage(number_chunks(chunks, settings.seed, settings.val_fraction, settings.shard_size, key, at), "prepared-numbers")
    write_shards(encoded_chunks(chunks, numbered, codes("samples"), settings.sr), f"{folder}/shards")

    counted = judged.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).agg(F.sum("rows").alias("n"))
    write_version(counted, folder, "skips", wave)
    write_version(spark.createDataFrame([(p,) for p in paths], FILES), folder, "files", wave)
    after = lambda s: F.coalesce(F.max(F.when(F.col("split") == s, F.col("shard_idx") + 1)), F.lit(at[s])).cast("bigint").alias(f"next_{s}_shard_idx")
    row = numbered.agg(*[after(s) for s in SPLITS], F.coalesce(F.max("n") + 1, F.lit(key)).cast("bigint").alias("global_key"))
    args = F.lit(json.dumps(settings.args(), sort_keys=True)).alias("args")
    write_version(row.select(F.lit(wave).cast("bigint").alias("wave"), "*", args), folder, "ledger", wave)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each finished wave, with the counters after it."""
    return read_output(spark, folder, "ledger", LEDGER, newest_version(spark, folder, "ledger"))


def completed_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose samples are in finished shards."""
    return read_output(spark, folder, "files", FILES, newest_version(spark, folder, "ledger"))


def preparation_skips(spark: SparkSession, folder: str) -> DataFrame:
    """Clips kept, and clips or rows skipped for each reason."""
    rows = read_output(spark, folder, "skips", SKIPS, newest_version(spark, folder, "ledger"))
    return rows.groupBy("skip_reason").agg(F.sum("n").alias("n"))
