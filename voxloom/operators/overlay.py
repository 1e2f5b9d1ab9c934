"""Keyed overlay of one named table on another, and the parameter inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(
    base: DataFrame, delta: DataFrame, prefix: str, bound: int, rename: str, name: str = "name"
) -> DataFrame:
    """Drop replaced layers of ``base``, then put the renamed ``delta`` rows over it.

    A base row is dropped if it lies under ``prefix`` and its third dotted part is a number of at
    least ``bound``; a part that is no number keeps the row.
    """
    layer = F.get(F.split(name, "\\."), F.lit(2)).try_cast("bigint")
    replaced = F.startswith(F.col(name), F.lit(prefix)) & (layer >= bound)
    renamed = delta.withColumn(name, F.concat(F.lit(rename), F.col(name)))
    kept = base.where(~F.coalesce(replaced, F.lit(False)))
    return kept.join(renamed.select(name), name, "left_anti").unionByName(renamed)


def inventory(weights: DataFrame, count: str = "numel", trainable: str = "trainable") -> DataFrame:
    total = F.sum(count)
    part = F.coalesce(F.sum(F.when(F.col(trainable), F.col(count))), F.lit(0).cast("bigint"))
    return weights.agg(
        total.alias("total"), part.alias("trainable"), (part / F.nullif(total, F.lit(0)) * 100.0).alias("trainable_percent")
    )
