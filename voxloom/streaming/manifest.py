"""Write shards from a stream and record each batch in a manifest after its shards are in place."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.order import SHARD_SIZE
from voxloom.operators.quality import stop_on_drift
from voxloom.session import stage
from voxloom.sinks.shards import number_samples, write_shards
from voxloom.sources.store import recover
from voxloom.streaming.state import newest_version, read_output, read_version, run_batches, write_version

VERSION = 1
MANIFEST = (
    "batch_id bigint, version int, next_train_shard_idx bigint, next_val_shard_idx bigint, "
    "global_key bigint, args string"
)
FILES = "path string"
COUNTERS = ("next_train_shard_idx", "next_val_shard_idx", "global_key")


def manifest_commit(
    samples: DataFrame,
    folder: str,
    order: Sequence[str],
    args: dict,
    size: int = SHARD_SIZE,
    write: Callable[[DataFrame, str], None] = partial(write_shards, replace=True),
    available_now: bool = True,
) -> StreamingQuery:
    """Number, shard and write a stream of (path, split, members, order columns).

    Numbers, keys and shards are found on ids; the members are joined to them once. Counters go on from the manifest row of the batch
    before; a start with other settings than it names stops on hard drift. The manifest row and the completed
    files are written after the shards, so a file counts as completed only once its samples are in
    place. All rows of a file have to come in one batch, as they do from a file source. Shards beyond the counters are left by a batch that died and are replaced. Each batch begins new shards; the last shard of a batch may be short.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        recover(spark, f"{folder}/shards")
        before = read_version(spark, folder, "manifest", batch_id - 1, MANIFEST).first()
        train, val, key = (before[c] if before else 0 for c in COUNTERS)
        rows = stage(batch.withColumn("_row", F.monotonically_increasing_id()), "stream-samples")
        ids = rows.select("_row", "path", "split", *order)
        numbered = stage(number_samples(ids, order, size, key, {"train": train, "val": val}), "stream-numbered")
        write(numbered.drop("path").join(rows.select("_row", "members"), "_row"), f"{folder}/shards")
        write_version(rows.select("path").distinct(), folder, "files", batch_id)
        after = lambda split, first: F.coalesce(
            F.max(F.when(F.col("split") == split, F.col("shard_idx") + 1)), F.lit(first).cast("bigint")
        )
        row = numbered.agg(
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.lit(VERSION).alias("version"),
            after("train", train).alias("next_train_shard_idx"),
            after("val", val).alias("next_val_shard_idx"),
            F.coalesce(F.max("n") + 1, F.lit(key)).cast("bigint").alias("global_key"),
            F.lit(json.dumps(args, sort_keys=True)).alias("args"),
        )
        write_version(row, folder, "manifest", batch_id)

    spark = samples.sparkSession
    last = manifest_state(spark, folder).first()
    stop_on_drift(spark, json.loads(last["args"]) if last else None, args)
    return run_batches(samples, folder, step, available_now)


def manifest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The counters after the last committed batch."""
    rows = read_output(spark, folder, "manifest", MANIFEST, newest_version(spark, folder, "manifest"))
    last = F.max_by(F.struct(*rows.columns), "batch_id")
    return rows.agg(last.alias("_last")).where(F.col("_last").isNotNull()).select("_last.*")


def completed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the batches up to the newest manifest row: its counters cover their samples."""
    return read_output(spark, folder, "files", FILES, newest_version(spark, folder, "manifest")).distinct()
