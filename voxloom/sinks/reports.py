"""CSV reports of an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.evaluate import STATS, summary_wide


def raw_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (checkpoint, sample_index) with a column per listed metric, and the ``error`` of a sample that failed, if there is such a column."""
    cells = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names]
    cells += [F.max("error").alias("error")] if "error" in metrics.columns else []
    return metrics.groupBy("checkpoint", "sample_index").agg(*cells)


def write_raw_metrics(metrics: DataFrame, names: Sequence[str], folder: str) -> None:
    raw_metrics(metrics, names).write.option("header", True).option("nullValue", "nan").csv(folder)


def _text(column: str) -> Column:
    number = F.col(column)
    if column.endswith("_n_valid"):
        return F.when(number > 0, number.cast("string")).otherwise(F.lit("nan")).alias(column)
    return F.when(number.isNull(), F.lit("nan")).otherwise(F.format_string("%.6f", number)).alias(column)


def summary_text(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """The wide summary as text: six decimals, ``nan`` where there is no valid value."""
    wide = summary_wide(summary, names)
    return wide.select("checkpoint", *[_text(f"{m}_{s}") for m in names for s in STATS])


def write_summary(summary: DataFrame, names: Sequence[str], folder: str) -> None:
    summary_text(summary, names).write.option("header", True).csv(folder)
