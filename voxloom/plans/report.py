"""The evaluation report over any long metrics table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from voxloom.operators.evaluate import best_run, box_stats, histogram, metric_values, summarize, to_long
from voxloom.operators.model import map_runs
from voxloom.session import stage
from voxloom.sinks.reports import write_raw_metrics, write_summary

RUNS = 1024


def evaluate_runs(
    samples: DataFrame,
    runs: Sequence[str] | DataFrame,
    factory: Callable,
    inputs: Sequence[str],
    metrics: Sequence[str],
    order: str | None = None,
    batch: int = 64,
) -> DataFrame:
    """Long metrics of every run on every sample: the model gets (checkpoint, inputs...) tuples.

    ``samples`` has a ``sample_index``. A sample on which a run fails has NULL metrics and its error. Samples are dealt to
    tasks once for every ``RUNS`` runs, a bound on what travels with a task; a table of runs is taken in the order of ``order`` and then of the name.
    """
    if isinstance(runs, DataFrame):
        name = [c for c in runs.columns if c != order][0]
        named = runs.orderBy(*dict.fromkeys([order or name, name])).select(name)
        runs = [r[0] for r in named.collect()]  # names only, as a list that a user types
    outputs = ", ".join(f"{m} double" for m in metrics)
    scored = [
        map_runs(samples, runs[at : at + RUNS], factory, inputs, outputs, ["sample_index"], batch, at) for at in range(0, max(len(runs), 1), RUNS)
    ]
    return to_long(reduce(DataFrame.unionByName, scored), ["checkpoint", "ckpt_ord", "sample_index", "error"], metrics)


@dataclass
class Report:
    summary: DataFrame
    winners: DataFrame
    histograms: DataFrame
    boxes: DataFrame


def evaluation_report(metrics: DataFrame, runs: DataFrame, names: Sequence[str], folder: str | None = None) -> Report:
    """Summary, winners, histograms and box statistics; raw and summary CSV if a folder is given.

    The metrics are computed once; the statistics read their values from one table, and the boxes take the quartiles of the summary.
    """
    values = metric_values(metrics)
    summary = stage(summarize(values), "summary")
    if folder is not None:
        write_raw_metrics(metrics, names, f"{folder}/raw_metrics")
        write_summary(summary, names, f"{folder}/summary_table")
    return Report(summary, best_run(summary, runs, names), histogram(values), box_stats(values, summary=summary))
