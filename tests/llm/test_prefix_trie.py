import hashlib
import random
import zlib

import pytest
from voxloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, conv string"


def tied(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tied(role, text), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            node = nodes.setdefault(turns[:d], {"convs": [], "ends": [], "children": 0})
            node["convs"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    for key in nodes:
        if key:
            nodes[key[:-1]]["children"] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for key, n in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += n["children"] == 0
            saved[key[:d]] += (len(n["convs"]) - 1) * len(key[-1][1]) if key else 0
    return sorted((
        min(n["convs"]), len(k), min(nodes[k[:-1]]["convs"]) if k else None, len(n["convs"]), n["children"], leaves[k], saved[k],
        hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest(),
    ) for k, n in nodes.items())


def cases(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 100, 101, 205, 230, 1_000_000]:
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", None, ""]), rng.choice([None, "", "a", "bé", "c" * 50]), "n", 1, None))
    for c in (7, 8):  # long ones that part late
        rows += [(c, 10 + t, "user", f"{t % 3}", "n", 1, None) for t in range(70)] + [(c, 90, "user", str(c), "n", 1, None)]
    rows += [(None, 1, "user", "lost", "n", 1, None)] + [(41, t, "user", "same", "n", 1, None) for t in (1, 1, 2)] * 2
    return rows


@pytest.mark.parametrize("seed,block,bound", [(1, 4096, 4096), (2, 16, 10)])
def test_against_brute_force(spark, seed, block, bound):
    rows = cases(seed)
    got = pt.conversations_trie(spark.createDataFrame(rows, SCHEMA), block, bound)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert pt.conversations_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_in_memory():
    rng = random.Random(5)
    for n in (1, 2, 30, 200):
        parent = [-1] + [rng.choice([i - 1, rng.randrange(i)]) for i in range(1, n)]
        children = [[i for i in range(n) if parent[i] == p] for p in range(n)]
        weight, want = [rng.randrange(9) for _ in range(n)], [0] * n
        mass = [1] * n
        for i in reversed(range(1, n)):
            mass[parent[i]] += mass[i]
        for i in range(n):
            at = i
            while at >= 0:
                want[at] += weight[i]
                at = parent[at]
        assert pt.split_component(0, parent, children, mass, [weight]) == [want]


def test_lists_of_many_ids(spark):
    rows = [(b"a", i) for i in range(500)] + [(b"b", 3)]
    got = {bytes(r.node): r.ends_sha256 for r in pt.joined_ids(spark.createDataFrame(rows, "node binary, conv long"), 7).collect()}
    assert got[b"a"] == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert got[b"b"] == hashlib.sha256(b"3").hexdigest()
