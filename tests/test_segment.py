import numpy as np
import pytest

from voxloom.operators import segment


def frames_of(spark, clips):
    rows = [(c, i, p) for c, probs in clips.items() for i, p in enumerate(probs)]
    return spark.createDataFrame(rows, "clip_id bigint, frame_idx bigint, prob double")


def hold(probs, lo, hi):
    """Decision by decision."""
    on, out = False, []
    for p in probs:
        on = True if p >= hi else False if p <= lo else on
        out.append(on)
    return out


def runs(flags):
    found, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            found.append((start, i - 1))
            start = None
    return found


@pytest.mark.parametrize("block_rows", [1, 3, 7, 65536])
def test_hysteresis_and_islands_do_not_depend_on_blocks(spark, block_rows):
    rng = np.random.default_rng(5)
    clips = {c: np.round(rng.random(rng.integers(1, 60)), 1).tolist() for c in range(6)}
    clips[6] = [0.4, 0.4, 0.5, 0.4, 0.35, 0.4, 0.9]  # dead band first, thresholds met exactly, run to the end
    clips[7] = [0.9] * 25  # one run over many blocks
    clips[8] = [0.1] * 5
    scored = segment.hysteresis(frames_of(spark, clips), block_rows=block_rows)
    got = {}
    for r in scored.orderBy("clip_id", "frame_idx").collect():
        got.setdefault(r["clip_id"], []).append(r["voiced"])
    want = {c: hold(p, 0.35, 0.5) for c, p in clips.items()}
    assert got == want
    found = segment.islands(scored, block_rows=block_rows).collect()
    assert sorted(map(tuple, found)) == sorted((c, s, e) for c, f in want.items() for s, e in runs(f))


def test_nan_score_decides_nothing(spark):
    scored = segment.hysteresis(frames_of(spark, {1: [0.9, float("nan"), 0.1, float("nan")]}))
    assert [r["voiced"] for r in scored.orderBy("frame_idx").collect()] == [True, True, False, False]


def test_empty_frames(spark):
    empty = frames_of(spark, {1: [0.5]}).where("false")
    assert segment.islands(segment.hysteresis(empty)).count() == 0


def test_frame_signal_ends_unvoiced(spark):
    signals = spark.createDataFrame(
        [(1, [1.0] * 8), (2, [1.0] * 9), (3, []), (4, [2.0])], "clip_id bigint, samples array<float>"
    )
    got = segment.frame_signal(signals, frame=4).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 0.0), (4, 0, 0.0)]


def test_segments_use_padded_coordinates(spark):
    clips = spark.createDataFrame([(1, 44100, 88200), (2, 44100, 1000)], "clip_id bigint, sr int, len bigint")
    clips = clips.unionByName(spark.createDataFrame([(3, 44100, 1000)], clips.schema))
    found = spark.createDataFrame(
        [(1, 0, 40), (1, 60, 70), (2, 0, 40), (3, 5, 20)], "clip_id bigint, f_start bigint, f_end bigint"
    )
    segs = segment.segments(found, clips)
    end = int(41 * 512 / 16000 * 44100)
    # The second run of clip 1 and that of clip 3 are too short; clip 2 is cut at its padded length.
    assert [tuple(r) for r in segs.orderBy("clip_id").collect()] == [
        (1, 44100, 0, end, True), (2, 44100, 0, 1000 + 2 * 22050, True)
    ]
    whole = segment.segments_or_whole(clips, segs).orderBy("clip_id").collect()
    assert [tuple(r) for r in whole[2:]] == [(3, 44100, 0, 1000, False)]


@pytest.mark.parametrize("block_rows", [5, 1 << 30])
def test_rejoin_offsets(spark, block_rows):
    segs = spark.createDataFrame(
        [(1, 20, 0, 10, True), (1, 20, 30, 35, True), (1, 20, 40, 60, True), (2, 20, 5, 9, True)],
        "clip_id bigint, sr int, s bigint, e bigint, padded boolean",
    )
    got = segment.rejoin(segs, 0.1, block_rows=block_rows).orderBy("clip_id", "s").select("clip_id", "out_start").collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 12), (1, 19), (2, 0)]


def test_rejoin_payload(spark):
    signals = spark.createDataFrame(
        [(1, 4, [1.0, 2.0, 3.0, 4.0]), (2, 4, [5.0, 6.0])], "clip_id bigint, sr int, samples array<float>"
    )
    segs = spark.createDataFrame(
        [(1, 1, 3, True), (1, 5, 7, True), (2, 0, 2, False)], "clip_id bigint, s bigint, e bigint, padded boolean"
    )
    got = segment.rejoin_payload(segs, signals, gap=0.25).orderBy("clip_id").collect()
    # Clip 1 is padded with two zeros at each side: 0 0 1 2 3 4 0 0.
    assert [list(r["samples"]) for r in got] == [[0.0, 1.0, 0.0, 4.0, 0.0], [5.0, 6.0]]
