"""Carried tables between micro-batches, in the stream's own folder.

A batch reads the state before it and writes its own, so a batch that is run again after a
failure starts from the same state and replaces its own output: results come out exactly once.

State that grows with the keys is cut in hash buckets (:class:`Buckets`). A batch reads and rewrites only the buckets that its
rows touch; an index of at most one row per bucket says in which batch each was last written. Once a batch is finished,
buckets that neither its index nor the one before it names are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.session import discard, scratch
from voxloom.sources.store import Store

BUCKETS = 256
INDEX = "bucket int, version bigint, buckets int"


def version_path(folder: str, name: str, batch_id: int) -> str:
    return f"{folder}/{name}/version={batch_id}"


def write_version(df: DataFrame, folder: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(version_path(folder, name, batch_id))


def read_version(spark: SparkSession, folder: str, name: str, batch_id: int, schema: str) -> DataFrame:
    """The version of one batch; the empty table before the first batch."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(folder, name, batch_id))


def newest_version(spark: SparkSession, folder: str, name: str) -> int:
    """Id of the newest batch whose table ``name`` is written in full, or -1.

    With the table that a batch writes last, this is the last finished batch. The folder is asked, as the
    progress of a query that found no new input names a batch that never ran.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    return max((int(f.getPath().getParent().getName().partition("=")[2]) for f in found), default=-1)


def read_output(spark: SparkSession, folder: str, name: str, schema: str, last: int) -> DataFrame:
    """An append-only output up to the batch ``last``; what an unfinished batch wrote is left out."""
    if last < 0:
        return spark.createDataFrame([], schema)
    version = F.regexp_extract("_metadata.file_path", r".*/version=(\d+)/", 1).cast("bigint")
    return spark.read.schema(schema).parquet(f"{folder}/{name}/version=*").where(version <= last)


class Buckets:
    """A keyed state table of which a batch rewrites only the buckets that it touches."""

    def __init__(self, folder: str, name: str, keys: Sequence[str], schema: str, count: int = BUCKETS):
        self.folder, self.name, self.keys, self.schema, self.count = folder, name, list(keys), schema, count
        self.index_name = f"{name}-index"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of some rows; at most ``count``."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def index(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """The batch in which each bucket was last written, after a batch."""
        rows = read_version(spark, self.folder, self.index_name, batch_id, INDEX).collect()
        if any(r["buckets"] != self.count for r in rows):
            raise ValueError(f"{self.name} in {self.folder} has {rows[0]['buckets']} buckets, not {self.count}")
        return {r["bucket"]: r["version"] for r in rows}

    def _path(self, bucket: int, version: int) -> str:
        return f"{version_path(self.folder, self.name, version)}/bucket={bucket}"

    def read(self, spark: SparkSession, batch_id: int, only: Sequence[int] | None = None) -> DataFrame:
        """The state after a batch, or some buckets of it."""
        index = self.index(spark, batch_id)
        paths = [self._path(b, v) for b, v in index.items() if only is None or b in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch_id: int, touched: Sequence[int]) -> None:
        """Replace the touched buckets by ``rows``, and write the index of the batch."""
        spark, path = rows.sparkSession, version_path(self.folder, self.name, batch_id)
        cut = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        cut.write.mode("overwrite").partitionBy("bucket").parquet(path)
        here = [int(n.partition("=")[2]) for n in Store(spark, path).names(path) if n.startswith("bucket=")]
        index = {b: v for b, v in self.index(spark, batch_id - 1).items() if b not in set(touched)} | dict.fromkeys(here, batch_id)
        listed = spark.createDataFrame([(b, v, self.count) for b, v in index.items()], INDEX)
        write_version(listed.coalesce(1), self.folder, self.index_name, batch_id)

    def drop_old(self, spark: SparkSession, batch_id: int) -> None:
        """Drop what neither a repetition of this batch nor the next one reads."""
        store = Store(spark, self.folder)
        versions = [int(n.partition("=")[2]) for n in store.names(f"{self.folder}/{self.index_name}") if n.startswith("version=")]
        needed = {x for v in (batch_id - 1, batch_id) for x in self.index(spark, v).items()}
        for old in sorted(v for v in versions if v < batch_id - 1):
            for bucket, version in self.index(spark, old).items():
                if (bucket, version) not in needed:
                    store.delete(self._path(bucket, version))
            store.delete(version_path(self.folder, self.index_name, old))


def run_batches(
    stream: DataFrame,
    folder: str,
    step: Callable[[DataFrame, int], None],
    available_now: bool = True,
) -> StreamingQuery:
    """Start ``step`` as a ``foreachBatch`` sink with its checkpoint inside ``folder``."""
    def tidy(batch: DataFrame, batch_id: int) -> None:
        with scratch() as inner:
            step(batch, batch_id)
        discard(batch.sparkSession, inner)

    writer = stream.writeStream.foreachBatch(tidy).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
