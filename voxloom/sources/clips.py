"""Raw clips: encoded bytes in Parquet, or decoded arrays in a nested column."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from voxloom.sources.shards import mounted

NESTED_CLIP = T.StructType(
    [
        T.StructField(
            "audio",
            T.StructType(
                [
                    T.StructField("array", T.ArrayType(T.FloatType())),
                    T.StructField("sampling_rate", T.IntegerType()),
                ]
            ),
        )
    ]
)


def read_clips(
    spark: SparkSession, folder: str, payload_col: str = "audio_data", glob: str = "*.parquet", keep: str = ""
) -> DataFrame:
    """(payload, path, row, kept columns...): one column of the Parquet files; unreadable files are skipped.

    ``folder`` may also be one file. ``glob`` is matched with the names of files, so a table that is itself a folder of parts is
    named as the folder. ``row`` is the row's index in its file; ``keep``, in DDL, names columns to carry along, such as an id that
    holds across the parts of a table. Empty payloads stay in (see ``nonempty_payload``).
    """
    kept = T.StructType.fromDDL(keep) if keep else T.StructType()
    schema = T.StructType([T.StructField(payload_col, T.BinaryType()), *kept])
    clips = (
        spark.read.schema(schema)
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .parquet(folder)
    )
    return clips.select(
        F.col(payload_col).alias("payload"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row"),
        *kept.names,
    )


def unreadable_files(spark: SparkSession, folder: str, clips: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """Input files of which no row could be read, with a skip reason."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    paths = listed.select(F.col("_metadata.file_path").alias("path"))
    silent = paths.join(clips.select("path").distinct(), "path", "left_anti")
    return silent.withColumn("skip_reason", F.lit("unreadable"))


# -- by row group, with a ledger of what is lost -------------------------------------------------

GROUPS_FORMAT = "voxclips"
GROUPS_DDL = "payload binary, path string, row bigint, row_group int, rows_lost bigint, skip_reason string"
READ_ROWS = 64
GROUP_BYTES = 128 << 20
GROUPS_COLUMNS = 6
NO_GROUP = -1  # the footer cannot be read, so nothing is known of the rows


def _loss(path: str, group: int, lost: int | None, why: str, schema: pa.Schema) -> pa.RecordBatch:
    given = [None, path, None, group, lost, why]
    return pa.record_batch([[v] for v in given + [None] * (len(schema) - len(given))], schema=schema)


def _group_rows(source, path: str, payload_col: str, start: int, end: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of the row groups whose middle lies in a byte range; a group that fails gives the rows before it and one row of loss.

    Columns of ``schema`` after those of ``GROUPS_DDL`` are read next to the payload.
    """
    keep = list(schema)[GROUPS_COLUMNS:]
    wanted = list(dict.fromkeys([payload_col, *(field.name for field in keep)]))
    try:
        file = pq.ParquetFile(source, page_checksum_verification=True)
        if missing := set(wanted) - set(file.schema_arrow.names):
            raise ValueError(f"no column {min(missing)}")
    except (pa.ArrowException, OSError, ValueError):
        if start == 0:
            yield _loss(path, NO_GROUP, None, "unreadable", schema)
        return
    first = 0
    for group in range(file.metadata.num_row_groups):
        about = file.metadata.row_group(group)
        columns = [about.column(i) for i in range(about.num_columns)]
        begin = min(c.dictionary_page_offset or c.data_page_offset for c in columns)
        middle = begin + sum(c.total_compressed_size for c in columns) // 2
        done, rows = 0, about.num_rows
        if start <= middle and (end is None or middle < end):
            try:
                for batch in file.iter_batches(READ_ROWS, row_groups=[group], columns=wanted):
                    values, n = batch.column(payload_col).cast(pa.binary()), batch.num_rows
                    at = pa.array(range(first + done, first + done + n), pa.int64())
                    none, kept = pa.nulls(n), [batch.column(field.name).cast(field.type) for field in keep]
                    yield pa.record_batch(
                        [values, pa.array([path] * n), at, pa.array([group] * n, pa.int32()), none.cast(pa.int64()), none.cast(pa.string()), *kept], schema=schema
                    )
                    done += n
            except (pa.ArrowException, OSError, ValueError):
                pass
            if done < rows:
                yield _loss(path, group, rows - done, "unreadable_rows", schema)
        first += rows


@dataclass
class GroupPartition(InputPartition):
    path: str
    start: int
    end: int


class GroupReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], payload_col: str, split_bytes: int, schema: pa.Schema):
        self.files, self.payload_col, self.split_bytes, self.schema = files, payload_col, split_bytes, schema

    def partitions(self) -> list[InputPartition]:
        step = self.split_bytes
        return [GroupPartition(path, at, at + step) for path, size in self.files for at in range(0, max(size, 1), step)]

    def read(self, partition: GroupPartition) -> Iterator[pa.RecordBatch]:
        return _group_rows(mounted(partition.path), partition.path, self.payload_col, partition.start, partition.end, self.schema)


class GroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return GROUPS_FORMAT

    def schema(self) -> str:
        return GROUPS_DDL

    def reader(self, schema) -> DataSourceReader:
        pairs = [line.rsplit("\t", 1) for line in self.options["files"].split("\n") if line]
        return GroupReader([(path, int(size)) for path, size in pairs], self.options["column"], int(self.options["splitBytes"]), to_arrow_schema(schema))


def read_clip_groups(
    spark: SparkSession, folder: str | Sequence[str], payload_col: str = "audio_data", glob: str = "*.parquet", split_bytes: int = GROUP_BYTES, keep: str = ""
) -> DataFrame:
    """(payload, path, row, row_group, rows_lost, skip_reason, kept columns...): the readable rows of every file, and a row for each loss.

    A damaged row group gives the rows before the damage and one row with a ``skip_reason`` and the number of ``rows_lost``, so rows read
    and rows lost add up to the footers. A file without a readable footer gives one row whose loss is unknown (NULL). An empty file
    gives nothing, and so does a folder without files. ``folder``, ``glob`` and ``keep`` are as in :func:`read_clips`. Files are listed by Spark. On a mounted path a task reads the row groups of one byte range; on any
    other store it is handed whole files, which then must be below 2 GB.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load([folder] if isinstance(folder, str) else list(folder))
    where = [folder] if isinstance(folder, str) else list(folder)
    schema = T.StructType.fromDDL(f"{GROUPS_DDL}, {keep}" if keep else GROUPS_DDL)
    arrow = to_arrow_schema(schema)
    if all(mounted(p) is not None for p in where):
        spark.dataSource.register(GroupSource)
        listed = "\n".join(f"{r['path']}\t{r['length']}" for r in files.select("path", "length").orderBy("path").collect())
        if not listed:  # Spark has a source without partitions read one that is None
            return spark.createDataFrame([], schema)
        reader = spark.read.format(GROUPS_FORMAT).schema(schema).option("files", listed).option("column", payload_col)
        return reader.option("splitBytes", split_bytes).load()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _group_rows(io.BytesIO(content.as_py()), path, payload_col, 0, None, arrow)

    return files.select("path", "content").mapInArrow(rows, schema)


def clip_losses(groups: DataFrame) -> DataFrame:
    """(path, row_group, rows_lost, skip_reason) of every loss."""
    return groups.where(F.col("skip_reason").isNotNull()).select("path", "row_group", "rows_lost", "skip_reason")


def read_nested_clips(
    spark: SparkSession,
    path: str,
    config: str | None = None,
    split: str = "train",
    streaming: bool = False,
    extra: T.StructType | None = None,
) -> DataFrame:
    """(samples, sr, extra...) from ``<path>[/<config>]/<split>``, in batch or as a stream."""
    folder = "/".join(p for p in (path, config, split) if p)
    schema = T.StructType(list(NESTED_CLIP) + list(extra or []))
    reader = spark.readStream if streaming else spark.read
    clips = reader.schema(schema).parquet(folder)
    others = [c for c in clips.columns if c != "audio"]
    return clips.select(*others, F.col("audio.array").alias("samples"), F.col("audio.sampling_rate").alias("sr"))
