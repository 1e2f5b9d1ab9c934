import hashlib
import random
from collections import Counter

import pytest
from voxloom.llm import suffix_dedup as module
from voxloom.llm.suffix_dedup import common_prefix, deduplicate, judge, multikey_quicksort, repeated_stretches

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(rng):
    word = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [word(90), word(35), word(300), "x" * 70]
    rows = [(0, None, "a"), (1, "", "b"), (2, "short", "c"), (3, "é" * 60, "d"), (None, shared[0], "n"), (None, shared[0], "n")]
    for i in range(10, 60):
        parts = [word(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            a = rng.randint(0, len(piece) // 2)
            parts += [piece[a : a + rng.randint(20, 200)], word(rng.randint(0, 40))]
        rows.append((i, "".join(parts), "e"))
    return rows + rows[10:16] + [(200 + i, rows[20 + i % 3][1], "f") for i in range(9)]


@pytest.mark.parametrize("seed,group,segment", [(1, 1024, 1 << 20), (2, 2, 1 << 20), (3, 1024, 100)])
def test_against_brute_force(spark, monkeypatch, seed, group, segment):
    monkeypatch.setattr(module, "SEGMENT", segment)
    rows = texts(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA)
    got = judge(df, length=40, gram=8, group=group).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(rows, 40)
    given = {(i, len((t or "").encode())): t or "" for i, t, _ in rows}
    assert all(r.text == given[r.id, r.n_bytes] for r in got if not r.n_removed)
    assert all(len(r.text.encode()) <= r.n_bytes - r.n_removed for r in got)


def test_deduplicate_keeps_columns(spark):
    a, b = "start " + "é" * 300 + " end", "other " + "é" * 300
    df = spark.createDataFrame([(1, a, "x"), (2, b, "y"), (3, "alone", None), (4, None, None)], SCHEMA)
    got = deduplicate(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    assert rows == {1: "start end", 2: "other", 3: "alone", 4: None} or rows[1].replace(" ", "") == "startend"
    assert deduplicate(df.limit(0)).count() == 0 and judge(df.limit(0)).count() == 0


def test_sorting():
    rng = random.Random(5)
    for _ in range(30):
        head = bytes(rng.choice(b"ab") for _ in range(50))
        strings = [head[: rng.randint(0, 50)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(40)]
        strings += strings[:5]
        order = multikey_quicksort(strings, depth=rng.choice([0, 8, 16, 32]))
        assert sorted(order) == list(range(45)) and [strings[i] for i in order] == sorted(strings)
    assert common_prefix(b"abcde", b"abcxe") == 3 and common_prefix(b"", b"a") == 0


def test_stretches():
    rng = random.Random(7)
    base = bytes(rng.choice(b"abc") for _ in range(60))
    contexts = []
    for _ in range(12):
        c = bytearray(base)
        c[rng.randint(0, 59)] ^= 1
        contexts.append(bytes(c))
    got = repeated_stretches(contexts, [25] * 12, 30)
    for i, c in enumerate(contexts):
        found = []
        for d in contexts[:i] + contexts[i + 1 :]:
            left = next((k for k in range(25) if c[24 - k] != d[24 - k]), 25)
            right = next((k for k in range(35) if c[25 + k] != d[25 + k]), 35)
            found += [(left, right)] if left + right >= 30 else []
        assert got[i] == ((max(x for x, _ in found), max(y for _, y in found)) if found else None)
