"""Incremental chunk assembly: the batch operators per micro-batch, with the lane ends carried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.assemble import chunk_slices, timeline
from voxloom.operators.scan import BLOCK_ROWS
from voxloom.session import stage
from voxloom.streaming.state import BUCKETS, Buckets, newest_version, read_output, run_batches, write_version

LANES = "lane string, start bigint, last_seq bigint, dropped bigint"
LATE = "lane string, seq bigint, clip_id bigint, len bigint"
SLICES = "lane string, chunk bigint, clip_id bigint, src_from bigint, src_to bigint, dst_from bigint"


def stream_assemble(
    pieces: DataFrame,
    folder: str,
    chunk: int,
    gap: int,
    block_rows: int = BLOCK_ROWS,
    available_now: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Assemble a stream of ``pieces(lane, seq, clip_id, len)`` into ``folder``.

    Each micro-batch places its pieces after the carried lane ends and emits the slices of chunks
    that are full by now; slices of the open chunk of each lane are kept. A piece whose ``seq`` is not
    beyond what its lane has seen is counted and written to the table of late pieces. Lanes are spread over tasks inside a
    micro-batch as in the batch operator. Of the carried lanes and open slices, a batch reads and writes the buckets of its own lanes.
    """
    of_lanes, of_open = _states(folder, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = of_lanes.touched(batch)
        lanes = of_lanes.read(spark, batch_id - 1, touched)
        kept = of_open.read(spark, batch_id - 1, touched)
        known = lanes.select("lane", "last_seq")
        marked = stage(
            batch.select("lane", "seq", "clip_id", "len")
            .join(known, "lane", "left")
            .withColumn("_late", F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))),
            "stream-pieces",
        )
        fresh = marked.where(~F.col("_late")).select("lane", "seq", "clip_id", "len")
        placed = stage(timeline(fresh, chunk, gap, lanes.select("lane", "start"), block_rows), "stream-placed")
        late = marked.groupBy("lane").agg(F.count(F.when(F.col("_late"), 1)).alias("_new_dropped"))
        ends = placed.groupBy("lane").agg(F.max("end").alias("_end"), F.max("seq").alias("_seq"))
        zero = F.lit(0).cast("bigint")
        now = stage(
            lanes.join(ends, "lane", "full").join(late, "lane", "full").select(
                "lane",
                F.coalesce("_end", "start", zero).alias("start"),
                F.coalesce("_seq", "last_seq").alias("last_seq"),
                (F.coalesce("dropped", zero) + F.coalesce("_new_dropped", zero)).alias("dropped"),
            ),
            "stream-lanes",
        )
        full = now.select("lane", F.floor(F.col("start") / chunk).cast("bigint").alias("_full"))
        cut = stage(kept.unionByName(chunk_slices(placed, chunk)).join(full, "lane"), "stream-slices")
        write_version(cut.where(F.col("chunk") < F.col("_full")).drop("_full"), folder, "slices", batch_id)
        of_open.write(cut.where(F.col("chunk") >= F.col("_full")).drop("_full"), batch_id, touched)
        write_version(marked.where("_late").select("lane", "seq", "clip_id", "len"), folder, "late", batch_id)
        of_lanes.write(now, batch_id, touched)
        for state in (of_open, of_lanes):
            state.drop_old(spark, batch_id)

    return run_batches(pieces, folder, step, available_now)


def _states(folder: str, buckets: int = BUCKETS) -> tuple[Buckets, Buckets]:
    """Lane ends and the slices of open chunks. A batch writes the lanes last."""
    return Buckets(folder, "lanes", ["lane"], LANES, buckets), Buckets(folder, "open", ["lane"], SLICES, buckets)


def assembled_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of all chunks emitted so far."""
    return read_output(spark, folder, "slices", SLICES, last_batch(spark, folder))


def late_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces that came after a later one of their lane and are in no chunk."""
    return read_output(spark, folder, "late", LATE, last_batch(spark, folder))


def flushed_slices(spark: SparkSession, folder: str, last_batch: int, buckets: int = BUCKETS) -> DataFrame:
    """At the end of the input: the slices of the open, incomplete chunk of each lane."""
    return _states(folder, buckets)[1].read(spark, last_batch)


def lane_state(spark: SparkSession, folder: str, last_batch: int, buckets: int = BUCKETS) -> DataFrame:
    return _states(folder, buckets)[0].read(spark, last_batch)


def last_batch(spark: SparkSession, folder: str) -> int:
    """Id of the last batch that was finished, or -1. A batch writes its lanes last."""
    return newest_version(spark, folder, "lanes-index")
