"""Run configurations and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings of a run, its files, and the rate of the base decoder.
CONFIG_DDL = (
    "base_upsample_rates array<int>, new_upsample_rates array<int>, extra_upsample_rate int, "
    "num_frozen_decoder_modules int, use_gan boolean, add_48k_decoder_block boolean, "
    "train_full_decoder boolean, step bigint, epoch bigint, training_type string, lambda_adv double, "
    "lambda_fm double, lambda_d_mpd double, lambda_d_msd double, lambda_multi_res_mel double, "
    "lambda_global_rms double, beta1_g double, beta2_g double, beta1_d double, beta2_d double, r1 double, "
    "d_reg_every int"
)
CONFIG_FILE = "config.json"
WEIGHTS_FILE = "decoder_block.safetensors"
BASE_RATE = 24000


def read_run_configs(
    spark: SparkSession,
    folder: str,
    config_file: str = CONFIG_FILE,
    weights_file: str | None = WEIGHTS_FILE,
    schema: str = CONFIG_DDL,
) -> DataFrame:
    """One row per ``<folder>/<run>/<config_file>``; a run without its weights file is an error."""
    configs = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(f"{folder}/*/{config_file}")
        .withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))
    )
    if weights_file is not None:
        missing = runs_without(spark, configs, folder, weights_file).limit(5).collect()
        if missing:
            raise FileNotFoundError(f"no {weights_file} in {', '.join(r['run'] for r in missing)}")
    return configs


def runs_without(spark: SparkSession, configs: DataFrame, folder: str, file: str) -> DataFrame:
    """Runs whose folder lacks a file. Only paths are listed, no content is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", file).load(f"{folder}/*")
    run = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    return configs.select("run").join(listed.select(run.alias("run")).distinct(), "run", "left_anti")


def output_rate(base_rate: int = BASE_RATE) -> Column:
    """Output rate of a run: the base rate, times the extra factor where the added block is in use."""
    added = F.coalesce("add_48k_decoder_block", F.lit(True))
    return F.lit(base_rate) * F.when(added, F.coalesce("extra_upsample_rate", F.lit(2))).otherwise(F.lit(1))


def read_train_log(
    spark: SparkSession, path: str, metrics: Sequence[str], ids: str, streaming: bool = False
) -> DataFrame:
    """Long log (ids..., metric, value) from JSON lines with one column per metric.

    ``ids`` is the DDL of the identifying columns. A metric that a line lacks gives no row.
    """
    schema = T.StructType.fromDDL(ids)
    wide = T.StructType(list(schema) + [T.StructField(m, T.DoubleType()) for m in metrics])
    reader = spark.readStream if streaming else spark.read
    quoted = [F.col(f"`{m}`") for m in metrics]
    long = reader.schema(wide).json(path).unpivot(schema.names, quoted, "metric", "value")
    return long.where(F.col("value").isNotNull())
