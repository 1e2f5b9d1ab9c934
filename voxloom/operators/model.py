"""The hook for models and per-clip signal code: batched, one instance per Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_instances: dict[Any, Any] = {}


def _instance(factory: Callable[[], Any], token: str) -> Any:
    if token not in _instances:
        _instances.clear()  # a reused worker holds one model at a time
        _instances[token] = factory()
    return _instances[token]


def _call(model: Callable[[list], list], rows: list, width: int) -> list[tuple]:
    """Outputs and error of each row; if the batch fails, its rows are tried one by one."""
    try:
        results = model(rows)
        if len(results) != len(rows):
            raise ValueError(f"{len(results)} results for {len(rows)} items")
        return [(*r, None) for r in results]
    except Exception as failure:  # noqa: BLE001 - a failing item must not end the run
        if len(rows) == 1:
            return [(*[None] * width, f"{type(failure).__name__}: {failure}")]
        return [_call(model, [row], width)[0] for row in rows]


def map_batches(
    df: DataFrame,
    factory: Callable[[], Callable[[list], list]],
    inputs: Sequence[str],
    outputs: T.StructType | str,
    keep: Sequence[str],
    batch: int = 64,
    token: str | None = None,
) -> DataFrame:
    """Call a model on batches of rows; adds the output columns and ``error``.

    ``factory`` builds the model on a worker, once per worker: ship a path, not a model. A factory
    is known by the hash of its pickled form, with all it captures, unless ``token`` names it. The model maps a list of input tuples
    to a list of output tuples. If a batch fails its items are tried one by one; an item that fails has NULL outputs and its error text,
    so one row comes out for each row that went in.
    """
    extra = T.StructType.fromDDL(outputs) if isinstance(outputs, str) else outputs
    schema = T.StructType(
        [df.schema[c] for c in keep] + list(extra) + [T.StructField("error", T.StringType(), True)]
    )
    names = [f.name for f in extra]
    identity = token or hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _instance(factory, identity)
        for frame in frames:
            rows = list(zip(*[frame[c] for c in inputs]))
            done: list[tuple] = []
            for i in range(0, len(rows), batch):
                done += _call(model, rows[i : i + batch], len(names))
            result = frame[list(keep)].reset_index(drop=True)
            for j, column in enumerate([*names, "error"]):
                result[column] = pd.Series([r[j] for r in done], dtype="object")
            yield result

    needed = list(dict.fromkeys([*keep, *inputs]))
    return df.select(*needed).mapInPandas(run, schema)


def map_runs(
    samples: DataFrame,
    runs: Sequence[str],
    factory: Callable[[], Callable[[list], list]],
    inputs: Sequence[str],
    outputs: T.StructType | str,
    keep: Sequence[str],
    batch: int = 64,
    first: int = 0,
) -> DataFrame:
    """Call a model on every run of every sample: checkpoint, ckpt_ord, the kept columns, the outputs and ``error``.

    A sample crosses to Python once, and the runs are looped over there: the model gets tuples (run, inputs...), the runs of one
    batch of samples one after the other, so that what it holds for a run serves a whole batch. ``runs`` travels with the task.
    ``ckpt_ord`` counts from ``first``.
    """
    extra = T.StructType.fromDDL(outputs) if isinstance(outputs, str) else outputs
    heads = [T.StructField("checkpoint", T.StringType()), T.StructField("ckpt_ord", T.IntegerType())]
    schema = T.StructType([*heads, *[samples.schema[c] for c in keep], *extra, T.StructField("error", T.StringType(), True)])
    names, listed = [f.name for f in extra], list(runs)
    identity = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _instance(factory, identity)
        for frame in frames:
            rows, kept = list(zip(*[frame[c] for c in inputs])), frame[list(keep)].reset_index(drop=True)
            for order, name in enumerate(listed, first):
                done: list[tuple] = []
                for i in range(0, len(rows), batch):
                    done += _call(model, [(name, *row) for row in rows[i : i + batch]], len(names))
                result = kept.copy()
                result.insert(0, "checkpoint", name)
                result.insert(1, "ckpt_ord", order)
                for j, column in enumerate([*names, "error"]):
                    result[column] = pd.Series([r[j] for r in done], dtype="object")
                yield result

    needed = list(dict.fromkeys([*keep, *inputs]))
    return samples.select(*needed).mapInPandas(run, schema)
