import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import assemble


def place(lengths, chunk, gap, at=0):
    """The running buffer, piece by piece."""
    out = []
    for n in lengths:
        begin = at + (gap if at % chunk else 0)
        at = begin + n
        out.append((begin, at))
    return out


def pieces_of(spark, lanes):
    rows = [(lane, seq, seq, n) for lane, items in lanes.items() for seq, n in items]
    return spark.createDataFrame(rows, "lane string, seq bigint, clip_id bigint, len bigint")


def check(spark, lanes, chunk, gap, **options):
    placed = assemble.timeline(pieces_of(spark, lanes), chunk, gap, **options)
    got = {}
    for r in placed.orderBy("lane", "seq").collect():
        got.setdefault(r["lane"], []).append((r["start"], r["end"]))
    assert got == {lane: place([n for _, n in sorted(items)], chunk, gap) for lane, items in lanes.items()}
    return placed


@pytest.mark.parametrize("chunk,gap", [(10, 3), (10, 0), (10, 10), (10, 20), (7, 4), (1, 1), (12, 8)])
def test_advances_and_composition(chunk, gap):
    rng = random.Random(chunk * 31 + gap)
    for _ in range(200):
        lengths = [rng.randrange(0, 15) for _ in range(rng.randrange(2, 30))]
        cut = rng.randrange(1, len(lengths))
        first, second = (assemble._advances(p, chunk, gap) for p in (lengths[:cut], lengths[cut:]))
        both = assemble._compose(first, second, chunk)
        whole = assemble._advances(lengths, chunk, gap)
        for entry in range(chunk):
            want = place(lengths, chunk, gap, entry)[-1][1] - entry
            assert whole.get(entry, whole[assemble.GENERIC]) == want
            assert both.get(entry, both[assemble.GENERIC]) == want


@pytest.mark.parametrize("block_rows,fan", [(1, 2), (4, 2), (16, 3), (50, 64), (100000, 64)])
def test_timeline_does_not_depend_on_blocks(spark, block_rows, fan):
    rng = random.Random(block_rows)
    lanes = {"hot": [(i, rng.randrange(0, 25)) for i in range(300)]}
    for k in range(5):
        lanes[f"lane{k}"] = [(s, rng.randrange(0, 25)) for s in rng.sample(range(400), rng.randrange(1, 9))]
    check(spark, lanes, 20, 3, block_rows=block_rows, fan=fan)


def test_equal_pieces_that_align_every_time(spark):
    check(spark, {"a": [(i, 17) for i in range(60)]}, 20, 3, block_rows=7, fan=2)
    check(spark, {"a": [(i, 20) for i in range(60)]}, 20, 3, block_rows=7, fan=2)


def test_timeline_goes_on_from_a_start(spark):
    pieces = pieces_of(spark, {"a": [(1, 5), (2, 8)], "b": [(1, 5)]})
    start = spark.createDataFrame([("a", 13)], "lane string, start bigint")
    for block_rows in (1, 100):
        got = assemble.timeline(pieces, 10, 2, start, block_rows=block_rows).orderBy("lane", "seq").collect()
        assert [(r["start"], r["end"]) for r in got] == [(15, 20), (20, 28), (0, 5)]


def test_empty_timeline(spark):
    assert assemble.timeline(pieces_of(spark, {"a": [(1, 1)]}).where("false"), 10, 1).count() == 0


@pytest.mark.parametrize("chunk,gap", [(20, 3), (5, 2), (64, 0)])
def test_chunks_hold_the_buffer(spark, chunk, gap):
    rng = random.Random(9)
    lengths = {i: rng.randrange(0, 50) for i in range(40)}
    samples = {i: [float(rng.randrange(1, 99)) for _ in range(n)] for i, n in lengths.items()}
    pieces = pieces_of(spark, {"x": [(i, n) for i, n in lengths.items() if i % 2], "y": [(i, n) for i, n in lengths.items() if not i % 2]})
    signals = spark.createDataFrame(list(samples.items()), "clip_id bigint, samples array<float>")
    placed = assemble.timeline(pieces, chunk, gap, block_rows=6, fan=2)
    slices = assemble.chunk_slices(placed, chunk)
    made = assemble.materialize_chunks(slices, signals, chunk).collect()
    tails = {r["lane"]: (r["chunk"], r["filled"], r["pad"]) for r in assemble.flush_tail(placed, chunk).collect()}
    for lane, parity in (("x", 1), ("y", 0)):
        ids = [i for i in sorted(lengths) if i % 2 == parity]
        spots = place([lengths[i] for i in ids], chunk, gap)
        buffer = [0.0] * spots[-1][1]
        for i, (begin, end) in zip(ids, spots):
            buffer[begin:end] = samples[i]
        filled = len(buffer) % chunk
        if filled:
            assert tails[lane] == (len(buffer) // chunk, filled, chunk - filled)
            buffer += [0.0] * (chunk - filled)
        else:
            assert lane not in tails
        want = {k: buffer[k * chunk : (k + 1) * chunk] for k in range(len(buffer) // chunk)}
        got = {r["chunk"]: list(r["samples"]) for r in made if r["lane"] == lane}
        # A chunk that is all silence has no slice.
        assert got == {k: v for k, v in want.items() if k in got}
        assert all(not any(v) for k, v in want.items() if k not in got)
    total = slices.selectExpr("sum(src_to - src_from)").first()[0]
    assert total == sum(lengths.values())


def test_bad_settings(spark):
    with pytest.raises(ValueError):
        assemble.timeline(pieces_of(spark, {"a": [(1, 1)]}), 0, 1)


@pytest.mark.parametrize("short", [0, 6, 1000])
def test_short_lanes_are_placed_like_long_ones(spark, monkeypatch, short):
    rng = random.Random(4)
    rows, start = [], {"l0": 7, "l3": 10}
    for lane in range(12):
        rows += [(f"l{lane}", i * 3, i, rng.randint(0, 14)) for i in range(rng.choice([1, 2, 6, 7, 20]))]
    monkeypatch.setattr(assemble, "SHORT", short)
    begun = spark.createDataFrame(list(start.items()), "lane string, start bigint")
    got = assemble.timeline(spark.createDataFrame(rows, "lane string, seq bigint, clip_id bigint, len bigint"), 10, 3, begun, block_rows=4, fan=2)
    want, at = [], dict(start)
    for lane, seq, clip, n in sorted(rows):
        end = at.get(lane, 0)
        begin = end + (3 if end % 10 else 0)
        at[lane] = begin + n
        want.append((lane, seq, clip, n, begin, begin + n))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert ("Pandas" in text) == (short < 20)


def test_a_gap_longer_than_a_chunk_gives_silent_chunks(spark):
    from voxloom.plans.corpus import chunk_signals

    lengths = [3, 4, 9, 2]
    signals = spark.createDataFrame([(i, 10, [float(i + 1)] * n) for i, n in enumerate(lengths)], "clip_id bigint, sr int, samples array<float>")
    got = chunk_signals(signals, F.lit("a"), 4, 9).orderBy("chunk").collect()
    line = [1.0] * 3 + [0.0] * 9 + [2.0] * 4 + [3.0] * 9 + [0.0] * 9 + [4.0] * 2
    line += [0.0] * (-len(line) % 4)
    assert [r["chunk"] for r in got] == list(range(len(line) // 4))
    assert [v for r in got for v in r["samples"]] == line
    assert any(not any(r["samples"]) for r in got)
