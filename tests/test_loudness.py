import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import loudness


def test_block_energy(spark):
    x = np.arange(30, dtype=np.float32) / 10
    signals = spark.createDataFrame([(1, x.tolist()), (2, [1.0] * 7), (3, [])], "clip_id bigint, samples array<float>")
    got = loudness.block_energy(signals, 2).orderBy("clip_id", "block_idx").collect()
    want = [float(np.mean(x[i : i + 8].astype(np.float64) ** 2)) for i in range(0, 30 - 8 + 1, 2)]
    assert [r["clip_id"] for r in got] == [1] * len(want)
    assert [r["energy"] for r in got] == pytest.approx(want)


@pytest.mark.parametrize("block_rows", [1, 3, 65536])
def test_gates(spark, block_rows):
    clips = {1: [1.0, 0.5, 1e-3, 1e-9, 0.0], 2: [0.0, 1e-12], 3: [0.2]}
    rows = [(c, i, e) for c, es in clips.items() for i, e in enumerate(es)]
    blocks = spark.createDataFrame(rows, "clip_id bigint, block_idx int, energy double")
    got = {r["clip_id"]: r for r in loudness.gated_loudness(blocks, block_rows=block_rows).collect()}
    level = lambda e: -0.691 + 10 * np.log10(e)
    first = np.mean([1.0, 0.5, 1e-3])
    kept = [e for e in (1.0, 0.5, 1e-3) if level(e) > level(first) - 10]
    assert got[1]["loudness"] == pytest.approx(level(np.mean(kept))) and got[1]["n_blocks"] == len(kept)
    assert got[2]["loudness"] is None and got[2]["n_blocks"] == 0
    assert got[3]["loudness"] == pytest.approx(level(0.2))


def test_gain(spark):
    df = spark.createDataFrame([(-20.0, 0.5), (-40.0, 0.5), (None, 0.5)], "l double, p double")
    got = [r[0] for r in df.select(loudness.normalize_gain("l", "p")).collect()]
    assert got[0] == pytest.approx(10 ** (-3 / 20))
    assert got[1] * 0.5 == pytest.approx(10 ** (-1 / 20))
    assert got[2] == 1.0
    one = spark.createDataFrame([([1.0, -2.0],)], "x array<float>").select(loudness.apply_gain("x", F.lit(0.5)), loudness.peak("x"))
    assert tuple(one.first()) == ([0.5, -1.0], 2.0)
