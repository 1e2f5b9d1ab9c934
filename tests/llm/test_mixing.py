import math
import random
import re

import pytest
from voxloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, host string, size int, copies int, place string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(rows, ceiling=3):
    """Targets by resharing the excess round by round."""
    size = {}
    for _, source, text, *_ in rows:
        size[source] = size.get(source, 0) + words(text)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = [s for s in order if s not in full]
        unit = (sum(size.values()) - sum(ceiling * size[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if unit * weight[s] > ceiling * size[s]}
        if not over:
            return size, {s: ceiling * size[s] if s in full else unit * weight[s] for s in order}
        full |= over


def cases(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([None, "tiny", "é"]) if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"s{rng.randrange(4)}"
        k = 40 if source == "hot" and rng.random() < 0.7 else int(rng.paretovariate(1.1))
        text = rng.choice([None, "", " \t"]) if rng.random() < 0.05 else "w\x0b\n" * min(k, 3000)
        rows.append((i, source, text, "x", 1, 1, None))
    return rows


@pytest.mark.parametrize("n,seed", [(1200, 1), (300, 2)])
def test_targets_and_copies(spark, n, seed):
    rows = cases(n, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert sorted((r.id, r.source, r["size"]) for r in got) == sorted((i, s, words(t)) for i, s, t, *_ in rows)
    size, target = wanted(rows)
    taken = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in got:  # no single copy more or less would come nearer
        left = target[r.source] - taken[r.source]
        moves = [r["size"]] * (r.copies < 3) + [-r["size"]] * (r.copies > 0)
        assert all(abs(left - m) >= abs(left) - 1e-6 for m in moves), (r, left)
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items() if size[s] > 1000)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_rates_solve_the_dual(spark):
    sizes = {"a": [(3, 10), (50, 4), (700, 1)], "b": [(1, 100), (9, 30)], "c": [(5, 7)], "d": [(2, 5), (4, 5)]}
    goal = {"a": 0.2, "b": 1.7, "c": 1.0, "d": 3.0}
    total = {h: sum(s * n for s, n in v) for h, v in sizes.items()}
    counts = spark.createDataFrame([(h, s, n) for h, v in sizes.items() for s, n in v], "host string, size long, n long")
    sources = spark.createDataFrame([(h, total[h], goal[h] * total[h]) for h in sizes], "host string, source_size long, target double")
    for r in mixing.rates(counts, sources).collect():
        rate = lambda s: min(3.0, math.exp(r.tilt * s / r["mean"]))
        assert sum(s * n * rate(s) for s, n in sizes[r.host]) == pytest.approx(goal[r.host] * total[r.host], rel=1e-6)


def test_repeated_ids_and_empty(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "a", "x"), (None, None, None), (2, "b", "p q r")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == 5 and all(r.target is not None for r in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_all_sources_empty(spark):
    got = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]
