import glob
import io
import os
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tests.compare import difference
from voxloom.functions.payloads import npy_bytes, npy_codes, wav_bytes, wav_signal
from voxloom.operators.batches import pad_batches, plan_batches
from voxloom.operators.model import map_batches
from voxloom.operators.scan import value_block
from voxloom.plans.corpus import load_batches, load_training
from voxloom.sinks.shards import number_samples, write_shards
from voxloom.sources import clips, runs
from voxloom.sources.shards import expand_shards, read_shards


def test_small_shards_share_a_task(spark, folder):
    rows = spark.range(120).selectExpr("id AS i", "'train' AS split", "map('txt', CAST(repeat(string(id), 50) AS BINARY)) AS members")
    write_shards(number_samples(rows, ["i"], 2, block=value_block("i")), folder)
    found = read_shards(spark, f"{folder}/train/shard-*.tar")
    got = {(r["shard"], r["key"], bytes(r["members"]["txt"])) for r in found.collect()}
    assert got == {(f"shard-{i // 2:06d}.tar", f"{i:08d}", str(i).encode() * 50) for i in range(120)}
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


def test_a_commit_asks_each_folder_once(spark, folder, monkeypatch):
    from voxloom.sources import store as journal

    asked, exists = [], journal.Store.exists
    monkeypatch.setattr(journal.Store, "exists", lambda self, path: asked.append(path) or exists(self, path))
    os.makedirs(f"{folder}/staged")
    for i in range(30):
        with open(f"{folder}/staged/{i}", "w") as file:
            file.write(str(i))
    store = journal.Store(spark, folder)
    journal.commit(store, folder, [(f"staged/{i}", f"train/{i}") for i in range(30)])
    assert not asked and sorted(os.listdir(f"{folder}/train")) == sorted(map(str, range(30)))
    with pytest.raises(FileNotFoundError, match="staged/1"):
        journal.commit(store, folder, [("staged/1", "train/new")])


def test_expand(tmp_path):
    for i in range(12):
        (tmp_path / f"s-{i:03d}.tar").write_bytes(b"")
    assert len(expand_shards(f"{tmp_path}/s-*.tar")) == 12
    listed = expand_shards(f"{tmp_path}/s-{{009..011}}.tar")
    assert [os.path.basename(p) for p in listed] == ["s-009.tar", "s-010.tar", "s-011.tar"]
    with pytest.raises(FileNotFoundError):
        expand_shards(f"{tmp_path}/none-*.tar")


def test_a_finished_shard_is_not_overwritten(spark, folder):
    rows = [("train", "shard-000000.tar", "00000000", {"txt": bytearray(b"1")})]
    df = spark.createDataFrame(rows, "split string, shard string, key string, members map<string,binary>")
    write_shards(df, folder)
    with pytest.raises(Exception, match="exist already"):
        write_shards(df, folder)
    assert len(glob.glob(f"{folder}/train/*")) == 1  # nothing half-written stays
    write_shards(df, folder, replace=True)
    assert read_shards(spark, f"{folder}/train/*.tar").count() == 1


def test_a_compressed_tar_is_not_shared_whatever_its_name(spark, folder):
    with tarfile.open(f"{folder}/a.tar", "w:gz") as tar:
        for i in range(4):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    assert read_shards(spark, f"{folder}/a.tar", split_bytes=10).count() == 4


def test_write_then_read(spark, folder):
    df = spark.range(50).withColumn("split", F.when(F.col("id") % 10 == 0, "val").otherwise("train"))
    members = F.create_map(F.lit("txt"), F.col("id").cast("string").cast("binary"), F.lit("wav"), F.lit(b"w"))
    numbered = number_samples(df.withColumn("members", members), ["id"], 20, block=value_block("id"))
    write_shards(numbered, folder)
    files = sorted(os.path.relpath(p, folder) for p in glob.glob(f"{folder}/[!_]*/*") if os.path.isfile(p))
    assert files == ["train/shard-000000.tar", "train/shard-000001.tar", "train/shard-000002.tar", "val/shard-000000.tar"]
    with tarfile.open(f"{folder}/train/shard-000000.tar") as tar:
        names = [m.name for m in tar]
    assert names[:2] == ["00000001.txt", "00000001.wav"] and len(names) == 40
    back = read_shards(spark, f"{folder}/*/shard-*.tar")
    got = {r["key"]: bytes(r["members"]["txt"]) for r in back.collect()}
    assert got == {f"{i:08d}": str(i).encode() for i in range(50)}


def test_a_large_tar_is_shared_by_tasks(spark, folder):
    df = spark.range(40).select(
        F.lit("train").alias("split"), F.lit("shard-000000.tar").alias("shard"),
        F.format_string("%08d", "id").alias("key"),
        F.create_map(F.lit("a"), F.col("id").cast("string").cast("binary"), F.lit("b"), F.lit(b"b")).alias("members"),
    )
    write_shards(df, folder)
    whole = read_shards(spark, f"file:{folder}/train/*.tar")
    shared = read_shards(spark, f"{folder}/train/*.tar", split_bytes=9000)
    assert whole.rdd.getNumPartitions() == 1 and shared.rdd.getNumPartitions() > 3
    as_set = lambda d: sorted((r["key"], bytes(r["members"]["a"]), len(r["members"])) for r in d.collect())
    assert as_set(shared) == as_set(whole) and len(as_set(whole)) == 40
    with pytest.raises(ValueError):
        expand_shards("hdfs://host/x/*.tar")


LONG = "a-name-that-needs-an-extension-header-" * 4


def make_tar(path, samples, data=None):
    """Samples of one to three members; some names are long, some data holds the word of a header."""
    want = {}
    with tarfile.open(path, "w", format=tarfile.PAX_FORMAT if samples % 2 else tarfile.GNU_FORMAT) as tar:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for i in range(samples):
            key = f"d/{LONG if i % 5 == 0 else ''}{i:05d}"
            for ext in ("wav", "npy", "seg.txt")[: i % 3 + 1]:
                body = data or (b"ustar\0" * 300 if i % 7 == 0 else bytes([i % 256]) * (i * 37 % 1500))
                info = tarfile.TarInfo(f"{key}.{ext}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                want.setdefault(key, {})[ext] = body
    return want


def members_by_key(df):
    rows = df.collect()
    found = {r["key"]: {k: bytes(v) for k, v in r["members"].items()} for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("split_bytes", [700, 5000, 40_000])
def test_byte_ranges_of_a_tar(spark, folder, split_bytes):
    want = make_tar(f"{folder}/a.tar", 41)
    shared = read_shards(spark, f"{folder}/a.tar", split_bytes=split_bytes)
    assert members_by_key(shared) == want


@pytest.fixture
def store(spark, folder):
    """A path that only Spark's readers can open, and the folder behind it."""
    name = f"store{abs(hash(folder))}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file:{folder}")
    return f"viewfs://{name}/in", folder


@pytest.mark.parametrize("split_bytes", ["900", "6000", "128m"])
def test_byte_ranges_in_a_store(spark, store, split_bytes):
    uri, folder = store
    want = make_tar(f"{folder}/a.tar", 41)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        df = read_shards(spark, f"{uri}/*.tar")
        assert members_by_key(df) == want
        if split_bytes != "128m":
            assert df.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def numbered(spark, n, size=10):
    df = spark.range(n).withColumn("split", F.when(F.col("id") % 4 == 0, "val").otherwise("train"))
    members = F.create_map(F.lit("txt"), F.col("id").cast("string").cast("binary"), F.lit("wav"), F.expr("cast(repeat('w', int(id * 97 % 2000)) as binary)"))
    return number_samples(df.withColumn("members", members), ["id"], size, block=value_block("id"))


def test_round_trip_in_a_store(spark, store):
    uri, folder = store
    write_shards(numbered(spark, 60), f"{uri}/corpus")
    names = sorted(os.path.relpath(p, folder) for p in glob.glob(f"{folder}/corpus/[!_]*/*"))
    assert names == [f"corpus/train/shard-00000{i}.tar" for i in range(5)] + [f"corpus/val/shard-00000{i}.tar" for i in range(2)]
    assert not glob.glob(f"{folder}/corpus/_staged*")
    with tarfile.open(f"{folder}/corpus/train/shard-000000.tar") as tar:  # a tar like any other
        assert len(tar.getmembers()) == 20
    got = members_by_key(read_shards(spark, f"{uri}/corpus/*/shard-{{000000..000001}}.tar"))
    assert members_by_key(read_shards(spark, f"{folder}/corpus/*/*.tar")).keys() > got.keys()
    assert len(got) == 35 and all(int(k) % 4 != 0 or v["txt"] == k.lstrip("0").encode() or v["txt"] == b"0" for k, v in got.items())
    listed = read_shards(spark, f"{uri}/corpus/train/shard-{{000000..000004}}.tar")
    assert listed.count() == 45


def test_a_commit_that_dies_leaves_nothing_visible(spark, folder, monkeypatch):
    from voxloom.sources import store as journal

    write_shards(numbered(spark, 8), f"{folder}/x")
    assert read_shards(spark, f"{folder}/x/*/*.tar").count() == 8
    moved, rename = [], journal.Store.rename

    def dies(self, old, new):
        if "_staged" in old and len(moved) == 2:
            raise OSError("the driver is lost")
        moved.append(new) if "_staged" in old else None
        rename(self, old, new)

    monkeypatch.setattr(journal, "CALLS", 1)
    monkeypatch.setattr(journal.Store, "rename", dies)
    more = numbered(spark, 60).withColumn("shard", F.concat(F.lit("more-"), "shard"))
    with pytest.raises(OSError, match="lost"):
        write_shards(more, f"{folder}/x")
    assert len(glob.glob(f"{folder}/x/*/more-*")) == 2  # put in place, but not seen
    assert read_shards(spark, f"{folder}/x/*/*.tar").count() == 8
    monkeypatch.setattr(journal.Store, "rename", rename)
    with pytest.raises(RuntimeError, match="recover"):
        write_shards(more, f"{folder}/x", replace=True)
    assert journal.recover(spark, f"{folder}/x") == 1 and journal.recover(spark, f"{folder}/x") == 0
    assert read_shards(spark, f"{folder}/x/*/*.tar").count() == 68


def test_no_shard_is_an_empty_table(spark):
    assert read_shards(spark, []).count() == 0 and read_shards(spark, []).columns == ["shard", "key", "members"]


def test_a_cut_tar_is_an_error(spark, folder):
    make_tar(f"{folder}/a.tar", 9, b"x" * 3000)
    with open(f"{folder}/a.tar", "r+b") as file:
        file.truncate(9000)
    with pytest.raises(Exception, match="inside a member"):
        read_shards(spark, f"{folder}/a.tar", split_bytes=4000).collect()


def test_reader_groups_members_of_a_key(spark, folder):
    with tarfile.open(f"{folder}/a.tar", "w") as tar:
        for name, data in [("d/1.seg.wav", b"x"), ("d/1.NPY", b"y"), ("2.wav", b"z"), ("noext", b"n"), (".hidden", b"h")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = [(r["key"], {k: bytes(v) for k, v in r["members"].items()}) for r in read_shards(spark, f"{folder}/a.tar").collect()]
    assert got == [("d/1", {"seg.wav": b"x", "npy": b"y"}), ("2", {"wav": b"z"})]


def test_payloads(spark):
    df = spark.createDataFrame([([1, -2, 32767, -32768], [5, 6])], "pcm array<smallint>, codes array<int>")
    made = df.select(wav_bytes("pcm", F.lit(24000)).alias("w"), npy_bytes("codes").alias("n"))
    row = made.select(wav_signal("w").alias("s"), npy_codes("n").alias("c"), "n").first()
    assert row["s"]["sr"] == 24000 and row["c"] == [5, 6]
    assert [round(v * 32768) for v in row["s"]["samples"]] == [1, -2, 32767, -32768]
    assert np.load(io.BytesIO(row["n"])).dtype == np.int32
    two_d, pickled = io.BytesIO(), io.BytesIO()
    np.save(two_d, np.zeros((2, 2), np.int32))
    np.save(pickled, np.array([{}], dtype=object), allow_pickle=True)
    bad = spark.createDataFrame([(bytearray(b),) for b in (b"no", two_d.getvalue(), pickled.getvalue())] + [(None,)], "b binary")
    rows = bad.select(npy_codes("b").alias("c"), wav_signal("b").alias("s")).collect()
    assert all(r["c"] is None and r["s"]["samples"] is None for r in rows)


def test_batches(spark):
    rows = [(i, [[1] * 16] * (i % 3 + 1), [1.0] * (i + 1)) for i in range(7)]
    df = spark.createDataFrame(rows, "id bigint, codes array<array<int>>, audio array<float>")
    got = pad_batches(plan_batches(df, ["id"], 3, value_block("id"))).orderBy("id").collect()
    assert [(r["batch_id"], r["pos"]) for r in got] == [(i // 3, i % 3) for i in range(7)]
    assert [len(r["audio"]) for r in got] == [3, 3, 3, 6, 6, 6, 7]
    assert [len(r["codes"]) for r in got] == [3] * 6 + [1]
    assert [(r["code_len"], r["audio_len"]) for r in got] == [(i % 3 + 1, i + 1) for i in range(7)]
    assert got[0]["codes"] == [[1] * 16, [0] * 16, [0] * 16] and got[0]["audio"] == [1.0, 0.0, 0.0]


def test_loading_drops_short_quiet_and_broken_samples(spark, folder):
    loud, quiet = [8000] * 400, [3] * 400
    rows = [("ok", loud, [1] * 16 * 13), ("short", loud, [1] * 16 * 11), ("quiet", quiet, [1] * 16 * 13),
            ("ragged", loud, [1] * 200), ("long", loud, list(range(16 * 40)))]
    df = spark.createDataFrame(rows, "id string, pcm array<smallint>, codes array<int>")
    members = F.create_map(F.lit("wav"), wav_bytes("pcm", F.lit(100)), F.lit("npy"), npy_bytes("codes"))
    numbered = number_samples(df.select("id", F.lit("train").alias("split"), members.alias("members")), ["id"], 100)
    write_shards(numbered, folder)
    loaded, skips = load_training(spark, f"{folder}/train/*.tar", 8, 1, max_s=2.0)
    got = {r["key"]: r for r in loaded.collect()}
    assert {r["skip_reason"]: r["n"] for r in skips.collect()} == {"kept": 2, "rms": 1, "bad_shape": 1, "duration": 1}
    assert load_batches(spark, f"{folder}/train/*.tar", 8, 1, max_s=2.0).count() == 2
    # In key order the rows are: long, ok, quiet, ragged, short.
    assert sorted(got) == ["00000000", "00000001"]
    assert got["00000000"]["code_len"] == 25 and got["00000000"]["audio_len"] == 200
    assert got["00000001"]["code_len"] == 13 and len(got["00000001"]["audio"]) == 400


def doubler():
    def call(rows):
        if any(x == 3 for (x,) in rows):
            raise ValueError("three")
        return [(2.0 * x,) for (x,) in rows]

    return call


def test_a_failing_item_loses_only_itself(spark):
    got = map_batches(spark.range(6), doubler, ["id"], "y double", ["id"], batch=4).orderBy("id").collect()
    assert [r["y"] for r in got] == [0.0, 2.0, 4.0, None, 8.0, 10.0]
    assert [r["error"] for r in got] == [None] * 3 + ["ValueError: three"] + [None] * 2


def test_sources_as_streams(spark, folder):
    audio = "named_struct('array', array(float(1), float(2)), 'sampling_rate', 44100) AS audio"
    spark.range(3).selectExpr(audio, "id").write.parquet(f"{folder}/clips/train")
    spark.range(4).selectExpr("id AS step", "double(id) AS `g/loss`").write.json(f"{folder}/log")
    nested = clips.read_nested_clips(spark, f"{folder}/clips", streaming=True)
    log = runs.read_train_log(spark, f"{folder}/log", ["g/loss", "val/loss"], "step bigint", streaming=True)
    for stream, name, rows in ((nested, "nested_clips", 3), (log, "train_log", 4)):
        assert stream.isStreaming
        query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() == rows
    assert spark.table("nested_clips").first()["sr"] == 44100


def test_corrupt_files_are_skipped_and_reported(spark, folder):
    spark.createDataFrame([(bytearray(b"abc"),), (None,)], "audio_data binary").coalesce(1).write.mode("append").parquet(folder)
    with open(f"{folder}/broken.parquet", "wb") as f:
        f.write(b"not parquet at all")
    found = clips.read_clips(spark, folder)
    assert found.count() == 2 and {r["row"] for r in found.collect()} == {0, 1}
    bad = clips.unreadable_files(spark, folder, found).collect()
    assert [(os.path.basename(r["path"]), r["skip_reason"]) for r in bad] == [("broken.parquet", "unreadable")]


@pytest.mark.parametrize("name", ["read_clips", "clip_groups"])
def test_a_table_may_be_a_folder_of_parts(spark, folder, name):
    pages = spark.range(40).selectExpr("id AS page_id", "string(id) AS url", "repeat(string(id), int(id % 7)) AS html")
    pages.repartitionByRange(3, F.desc("page_id")).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert difference(queries()[name](spark, folder), con, oracle_sql()[name]) is None


def test_columns_kept_next_to_clips(spark, folder):
    rows = spark.range(20).selectExpr("id + 100 AS id", "CAST(string(id) AS BINARY) AS audio_data").coalesce(1)
    rows.write.parquet(f"{folder}/a")
    for read in (clips.read_clips, clips.read_clip_groups):
        found = {(r["row"], r["id"], bytes(r["payload"])) for r in read(spark, f"{folder}/a", keep="id bigint").collect()}
        assert found == {(i, i + 100, str(i).encode()) for i in range(20)}


def test_a_folder_without_clips_is_an_empty_table(spark, folder):
    os.makedirs(f"{folder}/none")
    found = clips.read_clip_groups(spark, f"{folder}/none", keep="id bigint")
    assert found.count() == 0 and found.columns[-2:] == ["skip_reason", "id"]


def test_run_configs_need_their_weights(spark, folder):
    for name, weights in (("one", True), ("two", False)):
        os.makedirs(f"{folder}/{name}")
        with open(f"{folder}/{name}/config.json", "w") as f:
            f.write('{\n "new_upsample_rates": [8, 5, 2],\n "extra_upsample_rate": 2, "step": 7,\n "use_gan": true}\n')
        if weights:
            with open(f"{folder}/{name}/{runs.WEIGHTS_FILE}", "wb") as f:
                f.write(b"w")
    with pytest.raises(FileNotFoundError, match="two"):
        runs.read_run_configs(spark, folder)
    got = runs.read_run_configs(spark, folder, weights_file=None).withColumn("rate", runs.output_rate()).orderBy("run").collect()
    assert [(r["run"], r["step"], r["rate"], r["new_upsample_rates"]) for r in got] == [
        ("one", 7, 48000, [8, 5, 2]), ("two", 7, 48000, [8, 5, 2])
    ]
