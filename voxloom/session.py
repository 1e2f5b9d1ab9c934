"""Session helpers: the shared folder, staged tables, and the settings tests and bench use."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scratch = threading.local()  # a stream's batches run in a thread of their own


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "voxloom") -> SparkSession:
    """A local session for tests and the bench. On a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where it is installed on the executors or given by ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="run-voxloom-"), "voxloom")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none gets one temporary folder; a cluster session must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-voxloom-")
    return _local_dirs[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage so that a lost executor never changes an intermediate result, and it gives
    Catalyst the true size: a small staged table is broadcast by the normal size threshold, a
    large one is joined by shuffle. No broadcast hint is needed anywhere.
    """
    path = fresh_path(df.sparkSession, name)
    if getattr(_scratch, "noted", None):
        _scratch.noted[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by key to as many tasks as a shuffle has, and one for each core at least.

    For rows whose work is heavy next to their bytes: they may come from a few files, and adaptive execution, which goes
    by bytes, would gather them on a few tasks.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Notes the tables that this thread stages inside, so that :func:`discard` can drop them once what reads them is written."""
    noted: list[str] = []
    if not hasattr(_scratch, "noted"):
        _scratch.noted = []
    _scratch.noted.append(noted)
    try:
        yield noted
    finally:
        _scratch.noted.pop()


def discard(spark: SparkSession, tables: Sequence[str]) -> None:
    """Drop staged tables that no plan will read again."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(conf).delete(path, True)
