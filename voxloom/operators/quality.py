"""Skip accounting, pending inputs and configuration drift."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Which changed settings stop a resume and which only warn.
HARD_KEYS = ("shard_size",)
SOFT_KEYS = ("seed", "val_percent", "duration")
STATE_KEYS = ("num_frozen_decoder_modules",)


def skip_report(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows per group and skip reason; kept rows are counted under ``kept``."""
    reason = F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")
    return df.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def observe_skips(df: DataFrame, name: str = "skips") -> tuple[DataFrame, Observation]:
    """Live totals of kept and skipped rows, collected while another action runs."""
    seen = Observation(name)
    skipped = F.count("skip_reason")
    return df.observe(seen, (F.count(F.lit(1)) - skipped).alias("kept"), skipped.alias("skipped")), seen


def pending_inputs(files: DataFrame, completed: DataFrame, path: str = "path") -> DataFrame:
    """Distinct input files that the manifest does not list as completed."""
    return files.select(path).distinct().join(completed.select(path).distinct(), path, "left_anti")


def config_drift(
    prev: DataFrame,
    cur: DataFrame,
    by: Sequence[str],
    config: str = "config",
    hard: Sequence[str] = HARD_KEYS,
    soft: Sequence[str] = SOFT_KEYS,
    state: Sequence[str] = STATE_KEYS,
) -> DataFrame:
    """Changed settings per run with their severity, from two tables of (by..., config map).

    A setting that one side lacks counts as changed unless the other side holds NULL.
    """
    before = prev.select(*by, F.explode(config).alias("setting", "previous"))
    after = cur.select(*by, F.explode(config).alias("setting", "current"))
    severity = (
        F.when(F.col("setting").isin(*hard), F.lit("error"))
        .when(F.col("setting").isin(*soft), F.lit("warning"))
        .when(F.col("setting").isin(*state), F.lit("state_not_restored"))
        .otherwise(F.lit("info"))
    )
    return (
        before.join(after, [*by, "setting"], "full")
        .where(~F.col("previous").eqNullSafe(F.col("current")))
        .select(*by, "setting", "previous", "current", severity.alias("severity"))
    )


def stop_on_drift(spark: SparkSession, before: dict | None, now: dict, hard: Sequence[str] = HARD_KEYS, soft: Sequence[str] = SOFT_KEYS) -> None:
    """Refuse to go on with another value of a hard setting; warn of the soft ones. ``before`` is None at the first start."""
    if before is None:
        return
    table = lambda settings: spark.createDataFrame(
        [({k: str(v) for k, v in settings.items()},)], "config map<string,string>"
    )
    for row in config_drift(table(before), table(now), (), hard=hard, soft=soft).orderBy("setting").collect():
        said = f"{row['setting']} was {row['previous']} and is {row['current']}"
        if row["severity"] == "error":
            raise ValueError(f"the run cannot be resumed: {said}")
        if row["severity"] == "warning":
            warnings.warn(f"resumed with other settings: {said}", stacklevel=2)
