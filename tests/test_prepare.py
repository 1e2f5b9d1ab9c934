"""Row groups that fail, and a preparation that is stopped and goes on."""

import dataclasses
import glob
import io
import os
import wave

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxloom.plans import prepare
from voxloom.plans.prepare import Preparation, ledger, preparation_skips, prepare_corpus
from voxloom.sources.clips import clip_losses, read_clip_groups
from voxloom.sources.shards import read_shards

ROWS, GROUP = 500, 100


def damaged(path, compression):
    payload = [bytes([i % 251]) * (200 + i % 40) for i in range(ROWS)]
    table = pa.table({"other": list(range(ROWS)), "audio_data": payload})
    pq.write_table(table, path, row_group_size=GROUP, compression=compression, use_dictionary=False, write_page_checksum=True, data_page_size=2000)
    column = pq.ParquetFile(path).metadata.row_group(2).column(1)
    with open(path, "r+b") as file:
        file.seek(column.data_page_offset + column.total_compressed_size // 2)
        file.write(b"\xff" * 40)
    return payload


@pytest.mark.parametrize("compression", ["NONE", "SNAPPY"])
def test_rows_read_and_lost_are_those_of_the_footer(spark, folder, compression):
    payload = damaged(f"{folder}/a.parquet", compression)
    pq.write_table(pa.table({"audio_data": pa.array([], pa.binary())}), f"{folder}/empty.parquet")
    with open(f"{folder}/broken.parquet", "wb") as file:
        file.write(b"not parquet at all")
    pq.write_table(pa.table({"sound": [b"x"]}), f"{folder}/other.parquet")
    name = f"groups{abs(hash(folder))}"
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file:{folder}")
    for where, split in ((folder, 1 << 30), (folder, 20_000), (f"viewfs://{name}/in", 1)):
        found = read_clip_groups(spark, where, split_bytes=split).collect()
        read = {r["row"]: bytes(r["payload"]) for r in found if r["skip_reason"] is None}
        assert all(payload[i] == data for i, data in read.items())
        lost = {(os.path.basename(r["path"]), r["row_group"]): (r["rows_lost"], r["skip_reason"]) for r in found if r["skip_reason"]}
        assert lost.pop(("broken.parquet", -1)) == lost.pop(("other.parquet", -1)) == (None, "unreadable")
        assert list(lost) == [("a.parquet", 2)] and lost["a.parquet", 2][1] == "unreadable_rows"
        assert len(read) + lost["a.parquet", 2][0] == ROWS and len(read) >= ROWS - GROUP
    assert clip_losses(read_clip_groups(spark, folder)).count() == 3


SETTINGS = Preparation(
    sr=100, chunk=60, gap=5, hop=10, frame=10, low=0.02, high=0.05, min_voiced_s=0.1, join_gap_s=0.05, seed=1, val_fraction=0.2,
    shard_size=4, sr_min=50, wave_files=2,
)


def wav(i):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(20 if i % 9 == 4 else 100)
        file.writeframes((np.sin(np.arange(90 + 7 * i)) * 9000).astype("<i2").tobytes())
    return b"" if i % 11 == 5 else b"noise" if i % 11 == 6 else out.getvalue()


def codes(samples):
    return F.transform(F.slice(samples, 1, 48), lambda v: (v * 100).cast("int"))


def base(path):
    return F.regexp_extract(path, "([^/]+)$", 1)


def made(folder, names):
    for name in names:
        n = int(name[1:])
        pq.write_table(pa.table({"audio_data": [wav(n * 5 + i) for i in range(5)]}), f"{folder}/{name}.parquet")


def run(spark, source, out, settings=SETTINGS):
    files = spark.createDataFrame([(p,) for p in sorted(glob.glob(f"{source}/*.parquet"))], "path string")
    return prepare_corpus(spark, files, out, settings, codes, name=base)


def samples(spark, out):
    rows = read_shards(spark, f"{out}/shards/*/*.tar").collect()
    return sorted((r["shard"], r["key"], bytes(r["members"]["wav"])) for r in rows)


def test_a_wave_of_one_file_is_dealt_to_all_cores(spark, folder, monkeypatch):
    dealt, real = {}, prepare.stage

    def noted(df, name):
        dealt[name] = df.rdd.getNumPartitions()
        return real(df, name)

    os.makedirs(f"{folder}/in")
    made(f"{folder}/in", ["f0"])
    monkeypatch.setattr(prepare, "stage", noted)
    assert run(spark, f"{folder}/in", f"{folder}/out").count() == 1
    cores = spark.sparkContext.defaultParallelism
    assert dealt["prepared-clips"] >= cores and dealt["prepared-signals"] >= cores


def test_a_preparation_that_dies_goes_on(spark, folder, monkeypatch):
    source, whole, out = f"{folder}/in", f"{folder}/whole", f"{folder}/out"
    os.makedirs(source)
    made(source, ["f0", "f1", "f2"])
    assert run(spark, source, whole).count() == 2
    want = samples(spark, whole)
    real, calls = prepare.write_version, []

    def dies(df, where, name, version):
        calls.append(name)
        if len(calls) == 6:  # the shards of the second wave are there, its ledger row is not
            raise RuntimeError("the driver is lost")
        real(df, where, name, version)

    monkeypatch.setattr(prepare, "write_version", dies)
    with pytest.raises(RuntimeError, match="lost"):
        run(spark, source, out)
    monkeypatch.setattr(prepare, "write_version", real)
    assert ledger(spark, out).count() == 1
    with pytest.raises(ValueError, match="shard_size was 4 and is 5"):
        run(spark, source, out, dataclasses.replace(SETTINGS, shard_size=5))
    assert run(spark, source, out).count() == 2
    assert samples(spark, out) == want
    last = ledger(spark, out).orderBy("wave").collect()[-1]
    assert last["global_key"] == len(want) and len({k for _, k, _ in want}) == len(want)
    skips = {r["skip_reason"]: r["n"] for r in preparation_skips(spark, out).collect()}
    assert skips == {"kept": 15 - 1 - 1 - 2, "undecodable": 1, "low_rate": 2}
    assert run(spark, source, out).count() == 2  # nothing is pending
    made(source, ["f3"])
    assert run(spark, source, out).count() == 3
    assert len(samples(spark, out)) > len(want)
