import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import arrays


def one(spark, expr, **columns):
    """Evaluate a column over literal array columns."""
    names = list(columns)
    types = {"f": "array<float>", "i": "array<int>", "n": "int", "c": "array<array<float>>", "d": "double"}
    schema = ", ".join(f"{n} {types[n[0]]}" for n in names)
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr.alias("x")).first()["x"]


def test_pad(spark):
    assert one(spark, arrays.pad_to("f", 4), f=[1.0, 2.0]) == [1.0, 2.0, 0.0, 0.0]
    assert one(spark, arrays.pad_to("f", 1), f=[1.0, 2.0]) == [1.0, 2.0]
    assert one(spark, arrays.pad_edges("f", 2), f=[1.0]) == [0.0, 0.0, 1.0, 0.0, 0.0]
    assert one(spark, arrays.pad_to("f", 3), f=[]) == [0.0, 0.0, 0.0]


def test_downmix(spark):
    assert one(spark, arrays.downmix("c"), c=[[1.0, 2.0, 4.0], [3.0, 2.0, 0.0]]) == [2.0, 2.0, 2.0]
    assert one(spark, arrays.downmix("c"), c=[[1.0, 2.0]]) == [1.0, 2.0]
    assert one(spark, arrays.downmix("c"), c=[[], []]) == []


def test_pcm16_clips_and_truncates(spark):
    given = [-2.0, -1.0, -0.5, -1e-5, 0.0, 1e-5, 0.5, 1.0, 2.0, 0.99999]
    want = (np.clip(np.array(given, np.float32), -1.0, 1.0) * np.float32(32767)).astype(np.int16)
    assert one(spark, arrays.pcm16("f"), f=given) == want.tolist()
    assert one(spark, arrays.pcm16("f"), f=[float("nan"), 1.0]) == [0, 32767]


def test_levels(spark):
    x = np.array([0.1, -0.2, 0.3], np.float32)
    square = float(np.mean(x.astype(np.float64) ** 2))
    assert one(spark, arrays.rms_db("f"), f=x.tolist()) == pytest.approx(20 * np.log10(np.sqrt(square + 1e-8)))
    assert one(spark, arrays.rms("f"), f=x.tolist()) == pytest.approx(np.sqrt(square))
    assert one(spark, arrays.rms("f"), f=[]) is None
    assert one(spark, arrays.rms_db("f"), f=[0.0]) == pytest.approx(-80.0)


def test_code_bounds(spark):
    assert arrays.min_code_count(1.0) == 12
    kept = spark.range(10, 15).where(arrays.enough_codes("id", 1.0)).count()
    assert kept == 3  # 12, 13, 14
    reasons = spark.range(11, 128).where(arrays.duration_skip_reason("id").isNull()).agg(F.min("id"), F.max("id")).first()
    assert tuple(reasons) == (12, 125)


def test_crop_never_starts_at_the_last_window(spark):
    starts = spark.range(2000).select(arrays.crop_start(F.lit(28), 25, 1, "id").alias("s")).distinct()
    assert sorted(r["s"] for r in starts.collect()) == [0, 1, 2]
    assert one(spark, arrays.crop_start("n", 25, 1, "n"), n=25) == 0


def test_aligned_crop_fractional_rate(spark):
    codes, audio = [float(i) for i in range(30)], [float(i) for i in range(200)]
    got = one(spark, arrays.aligned_crop("f", "f2", F.lit(80), 2.0, 3, F.lit("k")), f=codes, f2=audio)
    start = got["start"]
    per = 80 / 12.5
    assert got["codes"] == codes[start : start + 25]
    assert got["audio"] == audio[int(start * per) : int((start + 25) * per)]


def test_pairs_and_masks(spark):
    a, b = arrays.align_pair("f", "f2")
    assert one(spark, F.array(F.size(a), F.size(b)), f=[1.0, 2.0, 3.0], f2=[1.0]) == [1, 1]
    assert one(spark, arrays.mask_tail("f", F.lit(1)), f=[1.0, 2.0]) == [1.0, 0.0]
    assert one(spark, arrays.mask_tail("f", F.lit(5)), f=[1.0, 2.0]) == [1.0, 2.0]


def test_codes_matrix(spark):
    flat = list(range(32))
    assert one(spark, arrays.codes_matrix("i"), i=flat) == [flat[:16], flat[16:]]
    assert one(spark, arrays.codes_matrix("i"), i=[]) == []
    assert one(spark, arrays.codes_matrix("i"), i=flat[:31]) is None
    assert one(spark, arrays.codes_skip_reason("i"), i=flat[:31]) == "bad_shape"
    assert one(spark, arrays.codes_skip_reason("i"), i=None) == "no_codes"


def test_every_n(spark):
    assert [r[0] for r in spark.range(0, 11).where(arrays.every_n("id", 5)).collect()] == [5, 10]
    with pytest.raises(ValueError):
        arrays.every_n("id", 0)


def test_weighted_sum_leaves_out_zero_weights(spark):
    df = spark.createDataFrame([(2.0, None)], "a double, b double")
    assert df.select(arrays.weighted_sum({"a": 1.5, "b": 0.0})).first()[0] == 3.0
    assert df.select(arrays.weighted_sum({"a": 1.5, "b": 1.0})).first()[0] is None


def test_nonempty_payload(spark):
    df = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"x"),)], "p binary")
    assert df.where(arrays.nonempty_payload("p")).count() == 1


def test_pick_payload_takes_the_first_listed(spark):
    df = spark.createDataFrame([({"flac": bytearray(b"f"), "mp3": bytearray(b"m")},), ({"txt": bytearray(b"t")},)], "m map<string,binary>")
    payload, ext = arrays.pick_payload("m")
    assert [tuple(r) for r in df.select(ext, payload).collect()] == [("mp3", b"m"), (None, None)]
