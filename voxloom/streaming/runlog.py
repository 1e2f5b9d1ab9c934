"""Running best and audio hours kept up to date on a live log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.runlog import RUN, cumulative_hours, running_best
from voxloom.operators.scan import BLOCK_ROWS
from voxloom.session import stage
from voxloom.streaming.state import BUCKETS, Buckets, newest_version, read_output, run_batches, write_version

STATE = "run_id string, segment string, best double, seconds double, last_step bigint, dropped bigint"
LATE = "run_id string, segment string, step bigint, value double, audio_sec double"
BEST = (
    "run_id string, segment string, step bigint, value double, audio_sec double, "
    "best_before double, is_best boolean, hours double"
)


def stream_running_best(
    log: DataFrame, folder: str, block_rows: int = BLOCK_ROWS, available_now: bool = True, buckets: int = BUCKETS
) -> StreamingQuery:
    """For a stream of (run_id, segment, step, value, audio_sec): is_best and hours per step.

    Steps at or before the last one seen in their run segment are counted and written to the table of late rows. Of the state of
    runs, a batch reads and writes the buckets of its own runs.
    """
    runs = _runs(folder, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = runs.touched(batch)
        state = runs.read(batch.sparkSession, batch_id - 1, touched)
        rows = batch.select(*RUN, "step", "value", "audio_sec")
        late = F.coalesce(F.col("step") <= F.col("last_step"), F.lit(False))
        joined = rows.join(state.drop("dropped"), list(RUN), "left").withColumn("_late", late)
        marked = stage(joined, "stream-log")
        fresh = marked.where(~F.col("_late")).drop("_late", "last_step")
        seen = running_best(fresh, block_rows=block_rows)
        before = F.least("best_before", "best")
        is_best = F.col("is_best") & (F.col("best").isNull() | (F.col("value") < F.col("best")))
        timed = cumulative_hours(
            seen.withColumn("best_before", before).withColumn("is_best", is_best), "audio_sec", block_rows=block_rows
        )
        hours = F.col("hours") + F.coalesce("seconds", F.lit(0.0)) / 3600.0
        out = timed.withColumn("hours", hours).drop("best", "seconds")
        write_version(out, folder, "best", batch_id)
        comparable = F.when(~F.col("_late") & ~F.isnan("value"), F.col("value"))
        counted = F.when(~F.col("_late"), F.col("audio_sec"))
        news = marked.groupBy(*RUN).agg(
            F.min(comparable).alias("_best"),
            F.sum(counted).alias("_seconds"),
            F.max("step").alias("_step"),
            F.count(F.when(F.col("_late"), 1)).alias("_dropped"),
        )
        zero, none = F.lit(0.0), F.lit(0).cast("bigint")
        now = state.join(news, list(RUN), "full").select(
            *RUN,
            F.least("best", "_best").alias("best"),
            (F.coalesce("seconds", zero) + F.coalesce("_seconds", zero)).alias("seconds"),
            F.greatest("last_step", "_step").alias("last_step"),
            (F.coalesce("dropped", none) + F.coalesce("_dropped", none)).alias("dropped"),
        )
        write_version(marked.where("_late").select(*RUN, "step", "value", "audio_sec"), folder, "late", batch_id)
        runs.write(now, batch_id, touched)
        runs.drop_old(batch.sparkSession, batch_id)

    return run_batches(log, folder, step, available_now)


def _runs(folder: str, buckets: int = BUCKETS) -> Buckets:
    return Buckets(folder, "runs", RUN, STATE, buckets)


def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    return read_output(spark, folder, "best", BEST, last_batch(spark, folder))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came after a later step of their run segment and are in no result."""
    return read_output(spark, folder, "late", LATE, last_batch(spark, folder))


def last_batch(spark: SparkSession, folder: str) -> int:
    """Id of the last batch that was finished, or -1. A batch writes the state of its runs last."""
    return newest_version(spark, folder, "runs-index")


def run_state(spark: SparkSession, folder: str, last_batch: int, buckets: int = BUCKETS) -> DataFrame:
    return _runs(folder, buckets).read(spark, last_batch)
