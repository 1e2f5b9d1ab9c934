"""Training-run analytics over a long log (run_id, segment, step, epoch, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.arrays import every_n
from voxloom.operators.scan import BLOCK_ROWS, SPARSE, earlier_min, running_sum

RUN = ("run_id", "segment")


def validation_mean(
    batches: DataFrame,
    by: Sequence[str] = ("run_id", "step"),
    order: str = "batch_no",
    max_batches: int = 50,
    evaluations: DataFrame | None = None,
) -> DataFrame:
    """Plain mean per evaluation and metric over its first ``max_batches`` batches.

    The limit is applied before the shuffle too, so a task sends at most ``max_batches`` rows per
    group. ``evaluations`` (by..., metric) adds 0.0 for those that had no batch at all.
    """
    first = Window.partitionBy(*by, "metric").orderBy(order)
    kept = batches.withColumn("_no", F.row_number().over(first)).where(F.col("_no") <= max_batches)
    means = kept.groupBy(*by, "metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_batches"))
    if evaluations is None:
        return means
    return evaluations.join(means, [*by, "metric"], "left").select(
        *by, "metric", F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("n_batches", F.lit(0).cast("bigint")).alias("n_batches"),
    )


def cumulative_hours(
    log: DataFrame, seconds: str = "value", by: Sequence[str] = RUN, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``hours``: audio hours seen up to each step of a run segment."""
    total = running_sum(log, F.coalesce(F.col(seconds), F.lit(0.0)), "_seconds", by, "step", block_rows=block_rows, levels=SPARSE)
    return total.withColumn("hours", F.col("_seconds") / 3600.0).drop("_seconds")


def running_best(log: DataFrame, by: Sequence[str] = RUN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``best_before`` and ``is_best``: strictly lower than all earlier values of the segment."""
    comparable = F.when(~F.isnan("value"), F.col("value"))
    seen = earlier_min(log, comparable, "best_before", by, "step", block_rows, SPARSE)
    is_best = comparable.isNotNull() & (F.col("best_before").isNull() | (comparable < F.col("best_before")))
    return seen.withColumn("is_best", is_best)


# The order in which saves happen at one step, and the checkpoint names.
SAVE_KINDS = ("best", "periodic", "epoch_end", "final")
BEST_NAME = "checkpoint-best"
STEP_NAME = "checkpoint-step-%d"


def checkpoint_events(
    log: DataFrame, save_every: int, num_epochs: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every save of a run: best, periodic, at the end of an epoch and at the end.

    ``log`` is the validation loss, one row per (run_id, segment, step), with ``epoch``.
    """
    def saves(rows: DataFrame, kind: str, epoch: Column | None = None) -> DataFrame:
        name = F.lit(BEST_NAME) if kind == "best" else F.format_string(STEP_NAME, "step")
        return rows.select(
            *RUN,
            F.col("step").cast("bigint").alias("step"),
            (F.col("epoch") if epoch is None else epoch).cast("bigint").alias("epoch"),
            F.lit(kind).alias("kind"),
            F.lit(SAVE_KINDS.index(kind)).alias("event_ord"),
            name.alias("name"),
        )

    best = running_best(log, block_rows=block_rows).where("is_best")
    periodic = log.where(every_n("step", save_every))
    epoch_end = log.groupBy(*RUN, "epoch").agg(F.max("step").alias("step"))
    final = log.groupBy(*RUN).agg(F.max("step").alias("step"))
    return (
        saves(best, "best")
        .unionByName(saves(periodic, "periodic"))
        .unionByName(saves(epoch_end, "epoch_end"))
        .unionByName(saves(final, "final", F.lit(num_epochs)))
    )


def surviving_checkpoints(events: DataFrame) -> DataFrame:
    """The save that is left under each name: the last one written."""
    written = F.struct("segment", "step", "event_ord")
    last = F.max_by(F.struct("segment", "step", "epoch", "kind"), written)
    return events.groupBy("run_id", "name").agg(last.alias("_last")).select("run_id", "name", "_last.*")
