import glob
import os

import pytest
from pyspark.sql import functions as F

from voxloom.operators.assemble import chunk_slices, timeline
from voxloom.operators.runlog import cumulative_hours, running_best
from voxloom.streaming import assemble, manifest, runlog
from voxloom.streaming.state import Buckets, write_version

PIECES = "lane string, seq bigint, clip_id bigint, len bigint"


def pieces(spark):
    rows = [("hot" if i % 3 else f"l{i % 5}", i, i, (i * 37) % 23) for i in range(90)]
    return spark.createDataFrame(rows, PIECES)


def arrive(spark, df, key, cuts, source, start):
    """Append one range of rows after the other, with a fresh query each time."""
    query, low = None, -1
    for high in cuts:
        df.where((F.col(key) > low) & (F.col(key) <= high)).coalesce(1).write.mode("append").parquet(source)
        query = start(spark.readStream.schema(df.schema).parquet(source))
        query.awaitTermination()
        low = high
    return query


def test_assembly_equals_batch(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    query = arrive(
        spark, pieces(spark), "seq", [9, 10, 55, 89], source,
        lambda s: assemble.stream_assemble(s, out, 10, 3, block_rows=16),
    )
    last = assemble.last_batch(spark, out)
    assert last == 3
    emitted = assemble.assembled_slices(spark, out)
    rest = assemble.flushed_slices(spark, out, last)
    want = chunk_slices(timeline(pieces(spark), 10, 3), 10)
    got = emitted.unionByName(rest)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # What is left over is the open chunk of each lane only.
    assert rest.groupBy("lane").agg(F.countDistinct("chunk").alias("n")).where("n > 1").count() == 0
    assert emitted.join(rest, ["lane", "chunk"]).count() == 0


def test_late_pieces_are_dropped_and_counted(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    first = spark.createDataFrame([("a", 5, 5, 4), ("a", 6, 6, 4)], PIECES)
    second = spark.createDataFrame([("a", 6, 9, 4), ("a", 7, 7, 4), ("b", 1, 1, 2)], PIECES)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        query = assemble.stream_assemble(spark.readStream.schema(PIECES).parquet(source), out, 10, 0)
        query.awaitTermination()
    state = {r["lane"]: (r["start"], r["last_seq"], r["dropped"]) for r in assemble.lane_state(spark, out, 1).collect()}
    assert state == {"a": (12, 7, 1), "b": (2, 1, 0)}
    assert [tuple(r) for r in assemble.late_pieces(spark, out).collect()] == [("a", 6, 9, 4)]


def test_a_repeated_batch_replaces_its_output(spark, folder):
    for _ in range(2):
        write_version(pieces(spark), folder, "x", 0)
    assert spark.read.parquet(f"{folder}/x/version=0").count() == 90


def test_a_batch_that_dies_halfway_is_run_again(spark, folder, monkeypatch):
    source, out = f"{folder}/in", f"{folder}/out"
    given = pieces(spark)
    given.where("seq < 40").coalesce(1).write.mode("append").parquet(source)
    start = lambda: assemble.stream_assemble(spark.readStream.schema(PIECES).parquet(source), out, 10, 3)
    start().awaitTermination()
    given.where("seq >= 40").coalesce(1).write.mode("append").parquet(source)
    real = Buckets.write

    def dies(self, rows, batch_id, touched):
        if self.name == "lanes":
            raise RuntimeError("executor lost")
        real(self, rows, batch_id, touched)

    monkeypatch.setattr(Buckets, "write", dies)
    with pytest.raises(Exception, match="executor lost"):
        start().awaitTermination()
    monkeypatch.setattr(Buckets, "write", real)
    query = start()
    query.awaitTermination()
    rest = assemble.flushed_slices(spark, out, assemble.last_batch(spark, out))
    got = assemble.assembled_slices(spark, out).unionByName(rest)
    want = chunk_slices(timeline(given, 10, 3), 10)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_running_best_equals_batch(spark, folder):
    rows = [(f"r{i % 2}", "s", i, float((i * 53) % 41), float(i % 7)) for i in range(80)]
    log = spark.createDataFrame(rows, "run_id string, segment string, step bigint, value double, audio_sec double")
    query = arrive(
        spark, log, "step", [3, 40, 79], f"{folder}/in",
        lambda s: runlog.stream_running_best(s, f"{folder}/out", block_rows=8),
    )
    got = runlog.best_so_far(spark, f"{folder}/out").orderBy("step").collect()
    want = cumulative_hours(running_best(log), "audio_sec").orderBy("step").collect()
    for column in ("step", "best_before", "is_best"):
        assert [r[column] for r in got] == [r[column] for r in want]
    assert [round(r["hours"], 9) for r in got] == [round(r["hours"], 9) for r in want]
    state = runlog.run_state(spark, f"{folder}/out", runlog.last_batch(spark, f"{folder}/out")).collect()
    assert {r["run_id"]: r["last_step"] for r in state} == {"r0": 78, "r1": 79}


def test_manifest_counts_on_after_a_restart(spark, folder):
    samples = spark.range(30).select(
        F.col("id"), F.concat(F.lit("f"), F.floor(F.col("id") / 10)).alias("path"),
        F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.create_map(F.lit("txt"), F.col("id").cast("string").cast("binary")).alias("members"),
    )
    arrive(
        spark, samples, "id", [9, 29], f"{folder}/in",
        lambda s: manifest.manifest_commit(s, f"{folder}/out", ["id"], {"shard_size": 6}, 6),
    )
    state = manifest.manifest_state(spark, f"{folder}/out").first()
    # Batch 0: 8 train rows in 2 shards and 2 val rows; batch 1: 16 train rows in 3 shards and 4 val rows.
    assert (state["next_train_shard_idx"], state["next_val_shard_idx"], state["global_key"]) == (5, 2, 30)
    assert manifest.completed_files(spark, f"{folder}/out").count() == 3


def test_a_quiet_restart_keeps_the_tail(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    assert assemble.last_batch(spark, out) == -1 and assemble.assembled_slices(spark, out).count() == 0
    pieces(spark).coalesce(1).write.mode("append").parquet(source)
    for _ in range(3):
        assemble.stream_assemble(spark.readStream.schema(PIECES).parquet(source), out, 10, 3).awaitTermination()
    assert assemble.last_batch(spark, out) == 0
    rest = assemble.flushed_slices(spark, out, assemble.last_batch(spark, out))
    got = assemble.assembled_slices(spark, out).unionByName(rest)
    want = chunk_slices(timeline(pieces(spark), 10, 3), 10)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_files_count_only_with_their_manifest_row(spark, folder, monkeypatch):
    source, out = f"{folder}/in", f"{folder}/out"
    rows = [(i, f"f{i // 5}", "train", {"txt": bytearray(b"x")}) for i in range(10)]
    samples = spark.createDataFrame(rows, "id bigint, path string, split string, members map<string,binary>")
    samples.coalesce(1).write.mode("append").parquet(source)
    start = lambda: manifest.manifest_commit(
        spark.readStream.schema(samples.schema).parquet(source), out, ["id"], {"shard_size": 4}, 4
    )
    real = manifest.write_version

    def dies(df, where, name, batch_id):
        if name == "manifest":
            raise RuntimeError("executor lost")
        real(df, where, name, batch_id)

    monkeypatch.setattr(manifest, "write_version", dies)
    with pytest.raises(Exception, match="executor lost"):
        start().awaitTermination()
    assert manifest.completed_files(spark, out).count() == 0
    monkeypatch.setattr(manifest, "write_version", real)
    start().awaitTermination()  # the shards of the batch that died are replaced
    assert manifest.completed_files(spark, out).count() == 2
    assert manifest.manifest_state(spark, out).first()["next_train_shard_idx"] == 3


def test_a_batch_writes_the_buckets_it_touches(spark, folder):
    source, out = f"{folder}/in", f"{folder}/out"
    many = spark.range(300).select(F.format_string("lane%d", "id").alias("lane"), F.lit(1).cast("bigint").alias("seq"), F.col("id").alias("clip_id"), F.lit(4).cast("bigint").alias("len"))
    one = lambda seq: spark.createDataFrame([("lane7", seq, 900 + seq, 4)], PIECES)
    given = [many, one(2), one(3), one(4)]
    for part in given:
        part.coalesce(1).write.mode("append").parquet(source)
        assemble.stream_assemble(spark.readStream.schema(PIECES).parquet(source), out, 10, 0, buckets=16).awaitTermination()
    written = lambda name, v: len(glob.glob(f"{out}/{name}/version={v}/bucket=*"))
    assert [written("lanes", v) for v in range(4)] == [15, 0, 1, 1]  # the first without the bucket of lane7; the second is superseded
    assert written("open", 0) == 15 and written("open", 3) == 1
    assert sorted(os.listdir(f"{out}/lanes-index")) == ["version=2", "version=3"]
    last = assemble.last_batch(spark, out)
    assert assemble.lane_state(spark, out, last, 16).count() == 300
    got = assemble.assembled_slices(spark, out).unionByName(assemble.flushed_slices(spark, out, last, 16))
    every = given[0].unionByName(given[1]).unionByName(given[2]).unionByName(given[3])
    want = chunk_slices(timeline(every, 10, 0), 10)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    with pytest.raises(ValueError, match="16 buckets"):
        assemble.lane_state(spark, out, last, 8)


def test_a_manifest_stops_on_hard_drift(spark, folder):
    rows = [(i, "f", "train", {"txt": bytearray(b"x")}) for i in range(4)]
    samples = spark.createDataFrame(rows, "id bigint, path string, split string, members map<string,binary>")
    samples.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(samples.schema).parquet(f"{folder}/in")
    manifest.manifest_commit(stream(), f"{folder}/out", ["id"], {"shard_size": 2, "seed": 1}, 2).awaitTermination()
    with pytest.raises(ValueError, match="shard_size was 2 and is 3"):
        manifest.manifest_commit(stream(), f"{folder}/out", ["id"], {"shard_size": 3, "seed": 1}, 3)
    with pytest.warns(UserWarning, match="seed"):
        manifest.manifest_commit(stream(), f"{folder}/out", ["id"], {"shard_size": 2, "seed": 5}, 2).awaitTermination()
