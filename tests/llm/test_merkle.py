import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from voxloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def grow(nodes):
    """Levels of a tree, from its leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def walk(levels, place, digest):
    proof = ""
    for level in levels[:-1]:
        first = place - place % 3
        left, right = "".join(level[first:place]), "".join(level[place + 1 : first + 3])
        proof, digest, place = proof + left + right, h(left, digest, right), place // 3
    return proof, digest


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[source] = grow([leaf(r, r[4]) for r in own])
    top = grow([trees[s][-1][0] for s in order])
    out = []
    for at, source in enumerate(order):
        for i, r in enumerate(groups[source]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = leaf(r, r[4].replace("\n", "") if bad else r[4])
            proof, digest = walk(trees[source], i, now)
            more, folded = walk(top, at, digest)
            root = top[-1][0]
            out.append((r[0], leaf(r, r[4]), trees[source][-1][0], root, h(proof + more), folded, folded == root))
    return sorted(out, key=repr)


def cases(n, sources):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}é"
        text = rng.choice([None, "", "a\nb", "no line end", "\n\n", "é\n" * 50, "x" * 30_000 + "\n"])
        rows.append((i * 7 - 5, source, rng.choice([None, "en"]), rng.choice([None, i]), text, "mine", i))
    return rows


@pytest.mark.parametrize("n,sources,height", [(1, 1, 2), (140, 3, 1), (200, 60, 2)])
def test_against_brute_force(spark, n, sources, height):
    rows = cases(n, sources)
    got = merkle.lines_joined_audit(spark.createDataFrame(rows, SCHEMA), height)
    assert got.columns[0] == "id"
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(None, "a", None, None, "x\ny", "", 0), (None, None, None, None, None, "", 0), (4, "a", "l", 1, "p\n", "", 0)] + [(4, "a", "l", 1, "q\n", "", 0)] * 3
    got = merkle.lines_joined_audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty(spark):
    assert merkle.lines_joined_audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_states_resume_at_every_slot():
    digests = [h(str(i)).encode() for i in range(11)]
    nodes, slots = merkle.grow(digests, 3)
    for place in range(11):
        at, steps = place, []
        for level, (_, right) in enumerate(merkle.siblings(nodes, 3, place)):
            steps.append((slots[level][at], right))
            at //= 3
        assert merkle.resume(steps, digests[place]) == nodes[3][0]
        assert merkle.resume(steps, b"0" * 64) != nodes[3][0]


def test_any_columns(spark):
    docs = spark.createDataFrame([(1, "x", "t"), (2, "x", "u")], "id long, tree string, body string")
    leaves = merkle.document_leaves(docs, ["id", "body"], "tree", {"body": F.lit("t")}, F.lit(True))
    assert {r.id: r.verified for r in merkle.manifest(leaves).collect()} == {1: True, 2: False}
